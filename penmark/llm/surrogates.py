"""Keyed surrogates for personal data and credentials, in DataFrame operations only.

Detected: e-mail addresses, telephone numbers (international, American, and national ones with a leading zero), card numbers that pass the Luhn check, IBANs that
pass their check (also as a run of whole groups inside a longer number), social security numbers, IPv4 and IPv6 addresses, credentials, and names of persons (a
known given name or a title before capitalised words, with initials and particles between them, and
each part of such a name again wherever it stands in the same text). All else stays as it is.

An entity is what all ways of writing it have in common (digits, lower case). A hash of a secret key,
the kind and the entity gives a surrogate of the same kind: names keep gender and script, numbers
their length, separators, country code and valid check digits, other strings the kind of each
character. All entities of the corpus are compared: of those with the same surrogate, and of those
whose surrogate is itself an entity of the corpus, all but the first try again. So different
entities stay different, and one entity has one surrogate everywhere.

Texts without entities are never shuffled. For the others, distinct mentions are joined with their
surrogates, and return to their text as a map of that text's own mentions.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penmark.llm.columns import apart
from penmark.session import materialise

# The session setting that names the secret key.
KEY_CONF = "spark.penmark.surrogateKey"
# From this attempt on surrogates grow longer, so every kind always has free values.
WIDER = 8

# Given names that mark a person, and titles.
FEMALE = (
    "Mary Anna Maria Emma Laura Julia Sarah Elizabeth Linda Patricia Susan Karen Nancy Emily Alice "
    "Charlotte Sophie Camille Claire Ingrid Petra Carmen Lucia Elena Ana Marie Julie Nicole Claudia Monika "
    "Sabine Isabel Sofia Teresa Amanda Jessica Jennifer Michelle Helen Rachel Rebecca Hannah Lucy Aiko Yuki "
    "Fatima Aisha Priya"
).split()
MALE = (
    "John James Robert Michael William David Richard Thomas Peter Paul Daniel George Henry Edward "
    "Pierre Jacques Antoine Hans Klaus Dieter Carlos Miguel Pedro Javier Juan José Jose Luis Antonio "
    "Francisco Diego Marco Luca Philippe Michel Stefan Andreas Markus Wolfgang Steven Andrew Joseph Charles "
    "Brian Kevin Matthew Ahmed Mohammed Kenji Hiroshi Raj"
).split()
FEMALE_CYRILLIC = "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split()
MALE_CYRILLIC = "Иван Сергей Дмитрий Алексей Андрей Михаил Николай Владимир".split()
TITLES = "Mr Mrs Ms Miss Dr Herr Frau Monsieur Madame Señor Señora Sra Sr".split()

# Names that surrogates are made of, none of them above.
NEW_FEMALE = "Ada Beatrice Cora Delia Edith Flora Greta Hilda Iris Judith Lydia Martha Nora Olivia Pauline Ruth Sylvia Vera".split()
NEW_MALE = "Adrian Basil Conrad Desmond Edgar Felix Gilbert Hugo Ivor Jasper Leonard Martin Nigel Oscar Quentin Rupert Silas Victor".split()
NEW_FEMALE_CYRILLIC = "Вера Галина Дарья Зоя Лидия Нина Раиса Тамара".split()
NEW_MALE_CYRILLIC = "Борис Вадим Глеб Егор Захар Леонид Павел Тимофей".split()

# Pieces of new surnames, one of each list in a row; some twenty million in Latin letters,
# some three million in Cyrillic ones.
SURNAME_PIECES = (
    "Al Ar Bal Bar Bel Ber Bran Cal Car Cor Dal Dar Dor El Er Fal Far Fen Gal Gar Gil Hal Har Hol Il Jar Kel Kin "
    "Lan Lor Mal Mar Mel Nor Or Pel Ral Ros Sel Tal Tor Ul Val Ver Wal Wen Yar Zel".split(),
    "a e i o u ade ane are ede ele ene ere ide ine ire ode one ore ude une ali eri osi uni".split(),
    "b c d f g l m n p r s t v br cr dr fl gr lm nd nt rn st tr".split(),
    "a e i o u ae ai au ea ei eu ia ie io oa oe oi ou ua ue ui uo ay oy".split(),
    "ck ll m rd st by den dor lt n r rs rt tt field ford ham s ley low man mere more ner ney ric ston well wick".split(),
)
SURNAME_PIECES_CYRILLIC = (
    "Ал Ар Бал Бар Бел Вар Вел Гал Гор Дар Дор Жар Зар Кал Кор Лар Мал Мер Нор Пол Сал Тар Тор Фал".split(),
    "а е и о у".split(),
    "б в г д ж з к л м н п р с т ф".split(),
    "а е и о у".split(),
    "б в г д ж з к л м н п р с т ф".split(),
    "ов ев ин ын енков аков".split(),
)

# Each part starts with what fails fast at most places: one character ahead or behind.
_EMAIL = (
    r"(?<![^\s,;:()<>\x22'=|])[^\s@,;:()<>\x22'=|]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)*\.\p{L}{2,}+(?![\p{L}\p{N}\-])"
)
_ACCESS_KEY = r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
_SECRET = (
    r"(?<=[=:\x22'] {0,1})"
    r"(?<=(?i:token|secret|api_key|apikey|password|passwd|pwd)[\x22']{0,1} {0,2}[=:] {0,2}[\x22']{0,1})"
    r"[^\s\x22'<>,;]{8,}+"
)
# Countries by the length of their IBAN.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}
_IBAN_END = "(?![0-9A-Za-z])"
_IBAN_REST = "|".join(
    f"(?<=(?:{countries.replace(' ', '|')})[0-9]{{2}})(?: ?[0-9A-Z]{{4}}){{{(n - 4) // 4}}}"
    + (f" ?[0-9A-Z]{{{n % 4}}}" if n % 4 else "")
    + _IBAN_END
    for n, countries in IBAN_LENGTHS.items()
)
_IBAN = (
    rf"(?<![0-9A-Za-z])[A-Z]{{2}}[0-9]{{2}}(?:{_IBAN_REST}"
    rf"|(?: ?[0-9A-Z]{{4}}){{2,7}}(?: ?[0-9A-Z]{{1,3}})?{_IBAN_END})"
)
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
_IPV6 = (
    rf"(?<![\p{{L}}0-9:._])(?=[0-9A-Fa-f:]*[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})"
    r"(?![\p{L}0-9:])"
)
_PHONE = (
    r"(?<![\p{L}0-9])\+1[ .\-]?\(?[0-9]{3}\)?[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}(?![0-9])"
    r"|(?<![\p{L}0-9])\+[2-9][0-9]{0,2}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])"
    r"|(?<![\p{L}0-9])\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}(?![0-9])"
    r"|(?<![\p{L}0-9.\-])[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4}(?![0-9\-])"
    r"|(?<![\p{L}0-9.\-])0[0-9]{2,4}[ \-][0-9]{3,4}[ \-][0-9]{3,4}(?![0-9\-])"
)
_SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
_CARD = r"(?<![\p{L}0-9.\-])[0-9](?:[ \-]?[0-9]){12,18}(?![\p{L}0-9\-])"
# The groups in which cards are written, for numbers that stand among others.
_CARD_GROUPS = (
    r"(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}(?:[ \-][0-9]{3})?|3[0-9]{3}[ \-][0-9]{6}[ \-][0-9]{4,5}"
    r"|4[0-9]{3}(?:[ \-][0-9]{3}){3}|[0-9]{6}[ \-][0-9]{7,13})"
)
_CAPITAL = "[A-ZÀ-ÞА-Я]"
_SMALL = "[a-zß-ÿа-я]"
_GIVEN = "|".join([*FEMALE, *MALE, *FEMALE_CYRILLIC, *MALE_CYRILLIC])
_BEFORE = "|".join([*FEMALE, *MALE, *FEMALE_CYRILLIC, *MALE_CYRILLIC, *TITLES])
# A part of a name (Smith, O'Brien, McDonald), and what may stand before the next one: initials, particles.
_WORD = rf"{_CAPITAL}(?:[\x27’]{_CAPITAL})?{_SMALL}++(?:{_CAPITAL}{_SMALL}++)?(?!\p{{L}})"
_INITIALS = rf"(?:(?:{_CAPITAL}\.){{1,3}}|{_CAPITAL})"
_PARTICLES = "(?:van|von|der|den|de|del|della|di|da|du|la|le|los|zu)"
_NEXT = rf"(?:(?: {_INITIALS}){{0,2}}(?: {_PARTICLES}){{0,2}} |-){_WORD}"
_NAME = (
    rf"(?:{_GIVEN})(?!\p{{L}})(?:{_NEXT}){{1,3}}"
    rf"|(?<=(?<!\p{{L}})(?:{'|'.join(TITLES)})\.{{0,1}} (?:(?:{_CAPITAL}\.){{1,2}} ){{0,1}})"
    rf"(?!(?:{'|'.join(TITLES)})(?!\p{{L}})){_WORD}(?:{_NEXT}){{0,3}}"
)
_BARE_WORD = rf"(?<!\p{{L}}){_WORD}"
_WHOLE_NAME = rf"^{_WORD}(?:{_NEXT})*$"
MENTION = (
    f"{_EMAIL}|(?=[0-9+(])(?:{_IP}|{_PHONE}|{_SSN}|{_CARD})|(?=[A-Z])(?:{_ACCESS_KEY}|{_IBAN})"
    rf"|{_SECRET}|(?={_HEX}:[0-9A-Fa-f:]){_IPV6}|(?={_CAPITAL}[\x27\u2019a-zß-ÿа-я])(?<!\p{{L}})(?:{_NAME})"
)
# Cheap to test, and true for every text with a mention.
MAYBE = (
    r"[@0-9]|AKIA|[=:](?<=(?i:token|secret|api_key|apikey|password|passwd|pwd)[\x22']{0,1} {0,2}[=:])"
    rf"|(?={_CAPITAL}{_SMALL})(?:{_BEFORE})(?:\.?[ \-]{_CAPITAL}| {_PARTICLES} )"
)

def _in(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _luhn(digits: str) -> str:
    """SQL: sum of the Luhn check over a string of digits."""
    x = f"cast(substring({digits}, length({digits}) - i + 1, 1) as int)"
    return (
        f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + "
        f"if(i % 2 = 0, 2 * {x} - if({x} > 4, 9, 0), {x}))"
    )


def _mod97(text: str) -> str:
    """SQL: a string of digits and capitals modulo 97, letters counting from A = 10."""
    c = f"substring({text}, i, 1)"
    v = f"if({c} between '0' and '9', cast({c} as int), ascii({c}) - 55)"
    return f"aggregate(sequence(1, length({text})), 0, (s, i) -> (s * if({v} > 9, 100, 10) + {v}) % 97)"


# In SQL raw strings the quote of the pattern is written by its number.
_EMAIL_SQL = _EMAIL.replace("'", r"\x27")
_PLAIN = "upper(regexp_replace(mention, '[^0-9A-Za-z]', ''))"

_KIND = rf"""CASE
 WHEN mention RLIKE r'^{_EMAIL_SQL}$' THEN 'email'
 WHEN mention RLIKE r'^{_IPV6}$' THEN 'ipv6'
 WHEN mention RLIKE r'^{_IP}$' THEN 'ip'
 WHEN mention RLIKE r'^AKIA[0-9A-Z]{{16}}$' THEN 'secret'
 WHEN mention RLIKE r'^{_IBAN}$' AND {_mod97(f"concat(substring({_PLAIN}, 5), substring({_PLAIN}, 1, 4))")} = 1 THEN 'iban'
 WHEN mention RLIKE r'^{_SSN}$' THEN 'ssn'
 WHEN mention RLIKE r'^(?:{_PHONE})$' THEN 'phone'
 WHEN mention RLIKE r'^{_CARD}$' THEN if({_luhn(_PLAIN)} % 10 = 0, 'card', 'none')
 WHEN mention RLIKE r'^{_IBAN}$' THEN 'none'
 WHEN mention IN ({_in(FEMALE)}) THEN 'female'
 WHEN mention IN ({_in(MALE)}) THEN 'male'
 WHEN mention IN ({_in(FEMALE_CYRILLIC)}) THEN 'female_cyrillic'
 WHEN mention IN ({_in(MALE_CYRILLIC)}) THEN 'male_cyrillic'
 WHEN mention RLIKE r'^\p{{IsCyrillic}}+а$' THEN 'surname_cyrillic_a'
 WHEN mention RLIKE r'^\p{{IsCyrillic}}+$' THEN 'surname_cyrillic'
 WHEN mention RLIKE r'^{_WORD}$' THEN 'surname'
 WHEN mention RLIKE r'^([^\p{{L}}\p{{N}}])\1*$' THEN 'none'
 ELSE 'secret' END"""

# Of a number that fails its check: the longest run of whole groups that passes one, and where it starts.
_STARTS = "filter(sequence(1, length(mention)), i -> i = 1 OR substring(mention, i - 1, 1) IN (' ', '-'))"
_ENDS = "filter(sequence(1, length(mention)), i -> substring(mention, i + 1, 1) IN ('', ' ', '-'))"
_SPANS = (
    f"flatten(transform({_STARTS}, a -> transform(filter({_ENDS}, b -> b >= a + 12), "
    f"b -> named_struct('n', b - a + 1, 'at', a, 'x', substring(mention, a, b - a + 1)))))"
)
_BARE = "regexp_replace(p.x, '[ -]', '')"
_VALID = rf"""(p.x RLIKE r'^{_CARD_GROUPS}$' AND {_luhn(_BARE)} % 10 = 0)
 OR (p.x RLIKE r'^{_IBAN}$' AND {_mod97(f"concat(substring({_BARE}, 5), substring({_BARE}, 1, 4))")} = 1)"""
_PART = f"array_max(transform(filter({_SPANS}, p -> {_VALID}), p -> named_struct('n', p.n, 'at', -p.at, 'x', p.x)))"
_CHECKED = f"(mention RLIKE r'^{_CARD}$' OR mention RLIKE r'^{_IBAN}$') AND mention RLIKE '[ -]'"

# Country codes stay: 1, or two digits after any other plus sign; so does the zero before a national
# number, unless it is written as an American one, which has the same entity with and without +1.
_ENTITY = rf"""CASE
 WHEN kind IN ('email', 'ipv6') THEN lower(mention)
 WHEN kind = 'phone' AND mention RLIKE r'^\+1[^0-9]' THEN substring({_PLAIN}, 2)
 WHEN kind = 'phone' AND mention LIKE '+%' THEN substring({_PLAIN}, 3)
 WHEN kind = 'phone' AND mention LIKE '0%' AND NOT mention RLIKE r'^[0-9]{{3}}[ .\-][0-9]{{3}}[ .\-][0-9]{{4}}$' THEN substring({_PLAIN}, 2)
 WHEN kind IN ('phone', 'card', 'ssn', 'iban') THEN {_PLAIN}
 ELSE mention END"""


def _pick(names: list[str], h: str) -> str:
    return f"element_at(array({_in(names)}), cast(1 + {h} % {len(names)} as int))"


def _names(names: list[str]) -> str:
    """SQL: a name from the list; later attempts join several, so there is always a free one."""
    h = "cast(conv(substring(sha2(concat(seed, '/', i), 256), 1, 8), 16, 10) as long)"
    return f"array_join(transform(sequence(0, attempt), i -> {_pick(names, h)}), '-')"


def _surnames(pieces: tuple[list[str], ...], ending: str = "") -> str:
    """SQL: a surname of one piece from each list; late attempts join several, so one is always free."""
    digits = lambda at: f"cast(conv(substring(sha2(concat(seed, '/', i), 256), {at}, 8), 16, 10) as long)"
    one = ", ".join(_pick(piece, digits(1 + 8 * n)) for n, piece in enumerate(pieces))
    return f"array_join(transform(sequence(0, greatest(0, attempt - 3)), i -> concat({one}, '{ending}')), '-')"


def _hex_shape(text: str) -> str:
    """SQL: each digit of a hexadecimal text replaced, all other characters as they are."""
    c = f"substring({text}, i, 1)"
    h = "cast(conv(substring(sha2(concat(seed, '/', i), 256), 1, 8), 16, 10) as long)"
    return (
        f"array_join(transform(sequence(1, length({text})), i -> "
        f"if({c} = ':', ':', substring('0123456789abcdef', cast(1 + {h} % 16 as int), 1))), '')"
    )


def _shape(text: str, seed: str = "seed") -> str:
    """SQL: each character replaced by one of its kind: digit, Latin or Cyrillic letter, case.

    Symbols stay, but a text of nothing else becomes small letters.
    """
    c = f"substring({text}, i, 1)"
    h = f"cast(conv(substring(sha2(concat({seed}, '/', i), 256), 1, 8), 16, 10) as long)"
    of = lambda letters: f"substring('{letters}', cast(1 + {h} % {len(letters)} as int), 1)"
    latin, cyrillic = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    return (
        f"array_join(transform(sequence(1, length({text})), i -> CASE "
        f"WHEN {text} RLIKE '^(?=.*[a-f])[0-9a-f]{{16,}}$' THEN {of('0123456789abcdef')} "
        f"WHEN {c} RLIKE r'\\p{{N}}' THEN {of('0123456789')} "
        f"WHEN {c} RLIKE r'[\\p{{IsCyrillic}}&&\\p{{Lu}}]' THEN upper({of(cyrillic)}) "
        f"WHEN {c} RLIKE r'\\p{{IsCyrillic}}' THEN {of(cyrillic)} "
        f"WHEN {c} RLIKE r'\\p{{Lu}}' THEN upper({of(latin)}) "
        f"WHEN {c} RLIKE r'\\p{{L}}' OR NOT {text} RLIKE r'[\\p{{L}}\\p{{N}}]' THEN {of(latin)} ELSE {c} END), '')"
    )


_DIGITS = "translate(concat(seed, sha2(seed, 256)), 'abcdef', '135792')"
_MORE = f"substring(translate(sha2(concat(seed, '/more'), 256), 'abcdef', '135792'), 1, greatest(0, attempt - {WIDER - 1}))"
_BYTE = "cast(conv(substring(seed, {}, 2), 16, 10) as int)"
_BODY = f"concat(substring(entity, 1, 1), substring({_DIGITS}, 1, length(entity) - 2), {_MORE}, '0')"
_BBAN = f"concat({_shape('substring(entity, 5)')}, {_MORE})"

_SURROGATE = rf"""CASE
 WHEN kind = 'email' THEN concat({_shape("substring_index(entity, '@', 1)")}, {_MORE}, '@',
   {_shape("regexp_replace(substring_index(entity, '@', -1), r'[.][^.]+$', '')", "concat(key, '/', substring_index(entity, '@', -1))")}, '.example')
 WHEN kind = 'ip' THEN concat(concat_ws('.', if(attempt < {WIDER // 2}, 10, 240 + {_BYTE.format(7)} % 16), {_BYTE.format(1)}, {_BYTE.format(3)}, {_BYTE.format(5)}), if({_MORE} = '', '', '-'), {_MORE})
 WHEN kind = 'phone' AND length(entity) = 10 THEN concat(2 + {_BYTE.format(1)} % 8, substring({_DIGITS}, 3, 2), 2 + {_BYTE.format(9)} % 8, substring({_DIGITS}, 11, 6), {_MORE})
 WHEN kind = 'phone' THEN concat(substring({_DIGITS}, 1, length(entity)), {_MORE})
 WHEN kind = 'card' THEN concat(substring({_BODY}, 1, length({_BODY}) - 1), (10 - {_luhn(_BODY)} % 10) % 10)
 WHEN kind = 'ssn' THEN concat('9', substring({_DIGITS}, 1, 8), {_MORE})
 WHEN kind = 'iban' THEN concat(substring(entity, 1, 2), lpad(cast(98 - {_mod97(f"concat({_BBAN}, substring(entity, 1, 2), '00')")} as string), 2, '0'), {_BBAN})
 WHEN kind = 'female' THEN {_names(NEW_FEMALE)}
 WHEN kind = 'male' THEN {_names(NEW_MALE)}
 WHEN kind = 'female_cyrillic' THEN {_names(NEW_FEMALE_CYRILLIC)}
 WHEN kind = 'male_cyrillic' THEN {_names(NEW_MALE_CYRILLIC)}
 WHEN kind = 'surname_cyrillic' THEN {_surnames(SURNAME_PIECES_CYRILLIC)}
 WHEN kind = 'surname_cyrillic_a' THEN {_surnames(SURNAME_PIECES_CYRILLIC, "а")}
 WHEN kind = 'surname' THEN {_surnames(SURNAME_PIECES)}
 WHEN kind = 'ipv6' THEN concat({_hex_shape("entity")}, {_MORE})
 WHEN entity LIKE 'AKIA%' AND length(entity) = 20 THEN concat('AKIA', {_shape("substring(entity, 5)")}, {_MORE})
 ELSE concat({_shape("entity")}, {_MORE}) END"""

# The surrogate in the separators and country code of the mention; what is longer follows at the end.
_FULL = f"concat(substring({_PLAIN}, 1, length({_PLAIN}) - length(entity)), surrogate)"
_RENDERED = rf"""CASE
 WHEN kind IN ('phone', 'card', 'ssn', 'iban') THEN concat(array_join(transform(sequence(1, length(mention)), i ->
   if(substring(mention, i, 1) RLIKE '[0-9A-Za-z]',
      substring({_FULL}, length(regexp_replace(substring(mention, 1, i), '[^0-9A-Za-z]', '')), 1),
      substring(mention, i, 1))), ''), substring({_FULL}, length({_PLAIN}) + 1))
 WHEN kind = 'email' AND mention = upper(mention) THEN upper(surrogate)
 ELSE surrogate END"""
# What stands around a part of the whole mention stays.
_AROUND = "concat(substring(whole, 1, at - 1), {}, substring(whole, at + length(mention)))"


# Random keys of applications without a configured one.
_random_keys: dict[str, str] = {}


def secret_key(spark: SparkSession) -> str:
    """The key of the session's configuration; without one a random key of this application, so that
    nobody can recompute surrogates, but another application's differ."""
    configured = spark.conf.get(KEY_CONF, None)
    if configured:
        return configured
    return _random_keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def surrogates(entities: DataFrame, key: str | None = None) -> DataFrame:
    """kind, entity and surrogate of distinct (kind, entity), all surrogates of a kind different."""
    key = key or secret_key(entities.sparkSession)
    todo, done = entities.select("kind", "entity"), None
    attempt = 0
    while True:
        candidates = (
            todo.withColumn("key", F.lit(key))
            .withColumn("attempt", F.lit(attempt))
            .withColumn("seed", F.sha2(F.concat_ws("|", "key", "kind", "entity", "attempt"), 256))
            .select("kind", "entity", F.expr(_SURROGATE).alias("surrogate"))
        )
        taken = entities.select("kind", F.col("entity").alias("surrogate"))
        if done is not None:
            taken = taken.union(done.select("kind", "surrogate"))
        first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("entity"))
        tried = candidates.withColumn("turn", first).join(
            taken.distinct().withColumn("taken", F.lit(True)), ["kind", "surrogate"], "left"
        )
        tried = materialise(tried.withColumn("free", (F.col("turn") == 1) & F.col("taken").isNull()), "surrogates")
        good = tried.filter("free").select("kind", "entity", "surrogate")
        done = good if done is None else done.union(good)
        todo = tried.filter("not free").select("kind", "entity")
        if todo.isEmpty():
            return done
        attempt += 1


def mentions(text: Column) -> Column:
    """All mentions of a text in order."""
    return F.regexp_extract_all(text, F.lit(MENTION), F.lit(0))


def replace_entities(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text`` and n_entities (mentions replaced) as a new column.

    Null and empty texts stay as they are, with 0 mentions. Repeated rows are kept and get equal
    texts. An empty table gives no rows. All other columns are kept; a column n_entities is replaced.
    """
    docs = docs.drop("n_entities")
    rows, _ = apart(docs, ("doc_id", "text"))
    names = rows.columns
    text = F.col("text")
    touched = F.coalesce(
        F.when(text.rlike(MAYBE), F.size(mentions(text)) > 0).otherwise(F.lit(False)), F.lit(False)
    )
    # The parts of a text's names count one by one, in the names and wherever else they stand.
    is_name = lambda m: m.rlike(_WHOLE_NAME)
    words = lambda t: F.regexp_extract_all(t, F.lit(_BARE_WORD), F.lit(0))
    # Written once: an id hash that spreads copies of one text, and what was found.
    id_hash = F.xxhash64("doc_id") if "doc_id" in names else F.lit(0).cast("long")
    with_some = (
        rows.filter(touched)
        .withColumn("_k1", id_hash)
        .withColumn("_k2", F.xxhash64("text"))
        .withColumn("_found", mentions(text))
        .withColumn("_words", F.array_distinct(F.flatten(F.transform(F.filter("_found", is_name), words))))
        .withColumn("_known", F.array_union(F.filter("_found", lambda m: ~is_name(m)), "_words"))
    )
    keyed = materialise(with_some, "found")
    # An inner generator would add a filter on its array, down to the scan of all texts.
    each = keyed.select("_k1", "_k2", F.explode_outer("_known").alias("mention"))
    each = each.filter("mention is not null").distinct()
    distinct = (
        each.select("mention")
        .distinct()
        .withColumn("kind", F.expr(_KIND))
        .withColumn("part", F.expr(f"CASE WHEN kind = 'none' AND {_CHECKED} THEN {_PART} END"))
        .selectExpr(
            "mention AS whole",
            "coalesce(-part.at, 1) AS at",
            "coalesce(part.x, mention) AS mention",
            "CASE WHEN part IS NULL THEN kind WHEN part.x RLIKE '^[A-Z]' THEN 'iban' ELSE 'card' END AS kind",
        )
        .filter("kind <> 'none'")
        .withColumn("entity", F.expr(_ENTITY))
    )
    known = materialise(distinct, "mentions")
    new = surrogates(known.select("kind", "entity").distinct(), key)
    rendered = materialise(
        known.join(new, ["kind", "entity"]).select(
            F.col("whole").alias("mention"), F.expr(_AROUND.format(_RENDERED)).alias("new")
        ),
        "rendered",
    )
    # Equal rows share a map.
    maps = (
        each.join(rendered, "mention")
        .groupBy("_k1", "_k2")
        .agg(F.map_from_entries(F.collect_list(F.struct("mention", "new"))).alias("_map"))
    )
    own = lambda w: F.array_contains("_words", w)

    def renamed(part: Column) -> Column:
        """A part of the text with the words of its own names replaced."""
        pieces = F.zip_with(
            F.split(part, _BARE_WORD, -1),
            words(part),
            lambda gap, w: F.concat(gap, F.when(own(w), F.element_at("_map", w)).otherwise(F.coalesce(w, F.lit("")))),
        )
        return F.when(F.size("_words") > 0, F.array_join(pieces, "")).otherwise(part)

    pieces = F.zip_with(
        F.split(text, MENTION, -1),
        "_found",
        lambda gap, found: F.concat(
            renamed(gap),
            F.when(found.isNull(), F.lit(""))
            .when(is_name(found), renamed(found))
            .otherwise(F.coalesce(F.element_at("_map", found), found)),
        ),
    )
    others = F.filter("_found", lambda m: ~is_name(m))
    # Names and gaps, without the other mentions, in one string.
    named = F.array_join(
        F.zip_with(
            F.split(text, MENTION, -1),
            "_found",
            lambda gap, found: F.concat(gap, F.lit("\n"), F.when(is_name(found), found).otherwise(F.lit("")), F.lit("\n")),
        ),
        "",
    )
    count = F.size(F.filter(others, lambda m: F.map_contains_key("_map", m))) + F.when(
        F.size("_words") > 0, F.size(F.filter(words(named), own))
    ).otherwise(0)
    changed = (
        keyed.join(maps, ["_k1", "_k2"], "left")
        .withColumn("_map", F.coalesce("_map", F.create_map().cast("map<string,string>")))
        .withColumn("n_entities", count)
        .withColumn("text", F.array_join(pieces, ""))
        .select(*names, "n_entities")
    )
    out = changed.union(rows.filter(~touched).select(*names, F.lit(0).alias("n_entities")))
    return out.toDF(*docs.columns, "n_entities")


def without_private_data(docs: DataFrame, key: str | None = None) -> DataFrame:
    """The documents with surrogates, in the same columns; n_chars, if any, is that of the new text.

    Null and empty texts and repeated rows stay; an empty table stays empty.
    """
    plain, restored = apart(docs, ("doc_id", "text"))
    out = restored(replace_entities(plain, key))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
