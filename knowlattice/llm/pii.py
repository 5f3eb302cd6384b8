"""Surrogates for personal data: each detected entity is replaced by a keyed one of its type and format.

Detection, replacement and the collision check are Spark expressions throughout. A surrogate is a function of the
secret key, the entity's type and its value, so the same entity has the same surrogate in every document. The check
takes the distinct entities of all documents, finds those whose surrogates coincide with another's or with a
real entity, and draws these again until all are distinct; only documents with such an entity look the draw up.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

KEY = "change-me: read it from a secret store"
MAX_DRAWS = 64

# Given names by gender and script, and syllables that surnames are made of.
GIVEN = {
    "latin": {
        "f": "Alice Anna Camille Carmen Clara Elena Emma Eva Greta Hannah Ines Julia Laura Lucia Maria Nadia Nora Sofia Teresa Vera".split(),
        "m": "Adam Andre Bruno Carlos Daniel David Emil Felix Hugo Jonas Karl Lucas Marco Martin Oscar Pablo Paul Peter Simon Victor".split(),
        "n": "Alex Andrea Charlie Dominique Jordan Kim Robin Sascha Taylor Toni".split(),
    },
    "cyrillic": {
        "f": "Анна Вера Елена Ирина Мария Надежда Ольга Светлана Татьяна Юлия".split(),
        "m": "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей".split(),
        "n": "Саша Женя Валя Слава".split(),
    },
}
#: Further given names that are found but never drawn.
FOUND = {
    "f": """Abigail Agnes Amanda Amelia Amy Andrea Angela Angelika Anita Ann Anne Annette Antonia Audrey Aurélie Barbara Beatriz Betty Birgit Brenda Brigitte Camila Carla Carol Caroline Catherine Cécile Céline Charlotte Chloé Christina Christine Claire Claudia Cristina Cynthia Deborah Denise Diana Diane Donna Doris Dorothy Élodie Elizabeth Elisabeth Emilia Emily Émilie Erika Esther Eva Frieda Gabriela Gisela Gloria Hanna Heather Heike Heidi Helen Helena Helga Inge Ingrid Isabel Isabella Isabelle Jacqueline Jana Jane Janet Janice Jasmin Jean Jennifer Jessica Joan Johanna Josefina Joyce Judith Judy Julie Juliette Karen Karin Katharina Katherine Kathleen Katrin Kelly Lara Laure Lea Léa Lena Leonie Linda Lisa Louise Lucy Lydia Madison Manon Margaret Margarita Marie Marta Martha Martina Mary Mathilde Megan Melanie Melissa Mercedes Mia Michelle Mónica Monika Nancy Natalia Nathalie Nicole Nina Olivia Pamela Patricia Paula Petra Pilar Rachel Raquel Rebecca Renate Rocío Rosa Ruth Sabine Samantha Sandra Sara Sarah Sharon Shirley Silvia Sonja Sophia Sophie Stefanie Stephanie Susan Susanne Sylvie Theresa Ursula Ute Valentina Valérie Vanessa Verónica Victoria Virginia""".split(),
    "m": """Aaron Alain Albert Alberto Alejandro Alexander Alfred Álvaro Andreas Andrew Anthony Antoine Antonio Arnaud Arthur Benjamin Bernd Bernhard Brandon Brian Charles Christian Christoph Christopher Claude Clément Dennis Didier Diego Dieter Dirk Donald Douglas Edward Eduardo Enrique Eric Étienne Ethan Eugene Fabian Fernando Florian Francisco François Frank Franz Frédéric Friedrich Gary George Georg Gerald Gerhard Gérard Gilles Gregory Guillaume Günter Hans Harald Harold Harry Heinrich Heinz Helmut Henri Henry Herbert Horst Ignacio Jack Jacob Jacques Jaime James Jan Jason Javier Jeffrey Jens Jeremy Jerry Jesús Jim Joachim Joe Johann Johannes John Johnny Jonathan Jorge José Jose Joseph Joshua Juan Julien Jürgen Justin Keith Kenneth Kevin Klaus Kurt Kyle Larry Laurent Lars Lawrence Leon Louis Ludwig Luis Luke Manfred Manuel Marcel Mark Markus Mathieu Matthew Matthias Max Maximilian Michael Michel Miguel Mohamed Mohammed Nathan Nicholas Nicolas Niklas Noah Norbert Olaf Olivier Otto Pascal Patrick Pedro Philip Philipp Philippe Pierre Rafael Rainer Ralf Ralph Raúl Raymond René Richard Robert Roberto Roger Roland Rolf Ronald Rüdiger Russell Ryan Samuel Scott Sean Sebastian Sébastien Sergio Stefan Stephan Stephen Steven Sven Terry Théo Thierry Thomas Thorsten Tim Timothy Tobias Tom Tyler Ulrich Uwe Vincent Walter Werner Wilhelm William Wolfgang Xavier Yann Yves Zachary""".split(),
}
SYLLABLES = {
    "latin": "bal ben bor dan del dor fal fen gar hal kel kor lan lin lor mar mel mon nar nel nor pal per ran rin ros sal sen sol tal ten tor val ven vor wal wen zan".split(),
    "cyrillic": "бал бер вал вен гор дан дор зор кал кор лан лен мар мер мол нав нор пав пол рав рин сав сол тал тов ход чер шан".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Frau Madame Mme Señora Sra г-жа Госпожа".split(),
    "m": "Mr Herr Monsieur Señor Sr г-н Господин".split(),
    "n": "Dr Prof".split(),
}

_word = r"[\p{L}\p{N}._%+-]"
TITLES = {g: [*ts, *(t.upper() for t in ts)] for g, ts in TITLES.items()}
_titles = "|".join(t for ts in TITLES.values() for t in ts)
_every = {n for by in (*GIVEN.values(), FOUND) for ns in by.values() for n in ns}
#: By first letters, so that few of them are tried at a place.
_given = "|".join(f"{a}(?:{'|'.join(sorted((n[1:] for n in _every if n[0] == a), reverse=True))})" for a in sorted({n[0] for n in _every}))
_key = r"(?i:token|secret|password|passwd|pwd|api_key|apikey|api-key)"
_name = r"\p{Lu}[\p{L}'’-]+"
#: Words after which two or three capitalised words are a person's name, whatever the given name.
INTRODUCED = ["name is ", "Name: ", "Dear ", "Regards, ", "regards, ", "Sincerely, ", "Signed, ", "Signed: ", "heiße ", "Gruß, ", "m'appelle ", "llamo ", "Atentamente, ", "зовут "]
_introduced = "|".join(re.escape(i[:-1]) + r"\s" for i in INTRODUCED)
#: Type and pattern of what is replaced, in the order in which alternatives are tried. Each asks for its first
#: character before anything dearer: a long lookbehind or list of words is then tried at few places of a text.
PATTERNS = {
    "email": rf"(?<!{_word}){_word}++@[\p{{L}}\p{{N}}-]+(?:\.[\p{{L}}\p{{N}}-]+)+",
    "secret": r"""(?<=["'])(?<=(?i:token|secret|password|passwd|pwd|api_key|apikey|api-key)["']?\s{0,3}[=:]\s{0,3}["'])[^"'\s]{8,}(?=["'])|(?=A)(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?=[spg])(?<![A-Za-z0-9])(?:sk|pk|ghp)[_-][A-Za-z0-9]{16,}|(?=e)(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*"""
    + rf"""|(?<=[=:]\s{{0,3}})(?:(?<={_key}\s{{0,3}}=\s{{0,3}})(?![\w.]*\()|(?<={_key}\s{{0,3}}:\s{{0,3}})(?=[^\s"',;]*\d))[^\s"',;]{{8,}}"""
    + r"|(?<=[Rr]\s{1,3})(?<=(?i:bearer)\s{1,3})[A-Za-z0-9._~+/=-]{16,}",
    "ipv6": r"(?=[0-9A-Fa-f:])(?<![\w:.])(?=[A-Fa-f:]{0,8}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:])",
    "ip": r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "iban": r"(?=[A-Z])(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?=\d)(?<![\d.-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?:[ -]?\d{3})?(?!\d|[.-]\d)"
    r"|(?=[3-6])(?<![\d.-])(?:3[47]\d\d[ -]?\d{6}[ -]?\d{5}|3[0689]\d\d[ -]?\d{6}[ -]?\d{4}|4\d{12}|(?:5[0678]|6\d)\d{11,17})(?!\d|[.-]\d)",
    "phone": r"(?=[\d(+])(?<![\p{L}\d.+-])(?:(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\+\d{1,3}(?:[ .-]\d{2,4}){2,5}|\+\d{8,14}|\d{3}[ .-]\d{3}[ .-]\d{4}|\d{3}-\d{2}-\d{4}"
    r"|\+\d(?:(?:[ ./-]|[ ./-]?\(|\)[ ./-]?)?\d){6,14}|(?:00[1-9]\d|\(?0[1-9])(?!(?<=\d\d)[./-]\d\d[./-]\d{2,4}(?![./-]?\d))(?:(?:[ ./-]|\)[ ./-]?)?\d){6,12}|[67]\d\d[ -](?:\d{3}[ -]\d{3}|\d\d(?:[ -]\d\d){2})|[89]\d[ -]\d{3}(?:[ -]\d\d){2})(?!\d|[.-]\d)",
    "name": rf"(?=[\p{{Lu}}г])(?<!\p{{L}})(?:(?:{_titles})\.? {_name}(?: {_name})?|(?:{_given})(?: \p{{Lu}}\.)? {_name}|(?<=\s)(?<=(?:{_introduced})){_name}(?: \p{{Lu}}\.)?(?: {_name}){{1,2}})(?!\p{{L}})",
}
#: All of them. Only numbers and capitals may follow a letter at once, so most places inside words fail at the first check.
PATTERN = rf"(?:(?=[0-9A-Z])|(?<!\p{{L}}))(?=\S)(?:{'|'.join(PATTERNS.values())})"
TYPES = list(PATTERNS)
_TITLE = rf"^(?:{_titles})\.? "


def type_of(entity: Column) -> Column:
    """Which pattern found it: the shapes exclude each other once the whole entity is known."""
    return (
        F.when(entity.rlike(rf"^(?:{PATTERNS['email']})$"), "email")
        .when(entity.rlike(rf"^(?:{PATTERNS['name']})$"), "name")
        .when(entity.rlike(rf"^(?:{PATTERNS['ip']})$"), "ip")
        .when(entity.rlike(rf"^(?:{PATTERNS['ipv6']})$"), "ipv6")
        .when(entity.rlike(rf"^(?:{PATTERNS['iban']})$"), "iban")
        .when(entity.rlike(rf"^(?:{PATTERNS['card']})$"), "card")
        .when(entity.rlike(rf"^(?:{PATTERNS['phone']})$"), "phone")
        # Found by the words before it; no secret has a space in it.
        .when(entity.rlike(rf"^{_name}(?: \p{{Lu}}\.)?(?: {_name}){{1,2}}$"), "name")
        .otherwise("secret")
    )


def _gender(entity: Column) -> Column:
    """From the title, else from the given name; n where neither tells."""
    title = F.regexp_extract(entity, rf"^({_titles})\.? ", 1)
    given = F.regexp_extract(entity, rf"^(?:(?:{_titles})\.? )?({_given})(?!\p{{L}})", 1)
    known = lambda names: F.when(given.isin(*names["f"]), "f").when(given.isin(*names["m"]), "m")
    return F.coalesce(
        F.when(title.isin(*TITLES["f"]), "f").when(title.isin(*TITLES["m"]), "m"), *[known(by) for by in (*GIVEN.values(), FOUND)], F.lit("n")
    )


def identity(entity: Column, kind: Column) -> Column:
    """What makes two mentions the same entity: case of an e-mail, spacing of numbers, the title of a name don't."""
    return (
        F.when(kind.isin("email", "ipv6"), F.lower(entity))
        .when(kind.isin("card", "iban"), F.regexp_replace(entity, "[ -]", ""))
        .when(kind == "phone", F.regexp_replace(entity, r"[^\d+]", ""))
        .when(kind == "name", F.concat(_gender(entity), F.lit("|"), F.lower(F.regexp_replace(entity, _TITLE, ""))))
        .otherwise(entity)
    )


def _stream(size: Column, *of: Column) -> Column:
    """Hexadecimal digits, three for each of ``size`` characters and 192 at least, that nobody without the key can tell from random ones."""
    seed = F.concat_ws("\u0001", *of)
    blocks = F.sequence(F.lit(1), F.greatest(F.lit(3), F.ceil(size * 3 / 64).cast("int")))
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("\u0001", b.cast("string"), seed), 256)), "")


def _number(stream: Column, place: int | Column, width: int = 6) -> Column:
    at = F.lit(place) if isinstance(place, int) else place
    return F.conv(F.substr(stream, at + 1, F.lit(width)), 16, 10).cast("long")


def _reshaped(value: Column, stream: Column, keep: int | Column = 0, hexadecimal: bool = False) -> Column:
    """The value with each letter and digit after the first ``keep`` characters replaced by one of its class, from the stream."""

    def one(c: Column, i: Column) -> Column:
        n = _number(stream, i * 3, 3)
        pick = lambda letters: F.substr(F.lit(letters), F.pmod(n, F.lit(len(letters))).cast("int") + 1, F.lit(1))
        low, high = ("abcdef", "ABCDEF") if hexadecimal else ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        new = F.when(c.rlike("[0-9]"), pick("0123456789")).when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфхцчшэюя")).when(c.rlike(r"\p{Lu}"), pick(high)).when(c.rlike(r"\p{L}"), pick(low)).otherwise(c)
        return F.when(i < keep, c).otherwise(new)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of the check-digit rule over a string of digits, the last of which is the check digit."""
    n = F.length(digits)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v))


def _into(shape: Column, characters: Column) -> Column:
    """The characters put in the places of the letters and digits of ``shape``; its spaces and hyphens stay."""
    places = F.transform(F.split(shape, ""), lambda c, i: F.when(c.rlike("[ -]"), c).otherwise(F.substr(characters, i + 1 - F.length(F.regexp_replace(F.substr(shape, F.lit(1), i + 1), "[^ -]", "")), F.lit(1))))
    return F.array_join(places, "")


def surrogate_identity(kind: Column, same: Column, draw: Column, d: Column, shared: Column) -> Column:
    """The replacement's identity (see ``identity``), from the entity's: of the same type, gender, script and format.

    ``d`` is the entity's stream of digits, ``shared`` that of an e-mail's domain. A draw above 0 lengthens e-mail
    addresses and surnames, so that short ones can't run out of values.
    """
    more = F.when(draw > 0, F.substr(d, F.lit(150), F.lit(6))).otherwise("")
    local, domain = F.substring_index(same, "@", 1), F.substring_index(same, "@", -1)
    # Only the public suffix stays (and the domains reserved for examples).
    end = F.regexp_extract(domain, r"(\.example\.(?:com|net|org)|\.(?:ac|co|com|edu|gob|gouv|gov|ne|net|or|org)\.[a-z]{2}|\.[^.]+)$", 1)
    head = F.substr(domain, F.lit(1), F.length(domain) - F.length(end))
    email = F.concat(_reshaped(local, d), more, F.lit("@"), F.when(head == "", domain).otherwise(F.concat(_reshaped(head, shared), end)))

    octet = lambda i: (F.pmod(_number(d, 6 * i), F.lit(254)) + 1).cast("string")
    ip = F.concat_ws(".", *[octet(i) for i in range(4)])

    ipv6 = F.concat_ws(":", *[F.substr(d, F.lit(4 * i + 1), F.lit(4)) for i in range(8)])

    body = F.substr(_reshaped(same, d, 1), F.lit(1), F.length(same) - 1)
    # The check digit of the body, or another digit where the original number fails the check too.
    check = F.pmod(10 - _luhn(F.concat(body, F.lit("0"))) + F.when(_luhn(same) % 10 == 0, 0).otherwise(1), F.lit(10))
    card = F.concat(body, check.cast("string"))

    phone = _reshaped(same, d, F.length(F.regexp_extract(same, r"^(\+\d{1,2}|0)", 1)))

    gender, name = F.substr(same, F.lit(1), F.lit(1)), F.substr(same, F.lit(3), F.length(same))

    def named(script: str) -> Column:
        choose = lambda values, at: F.get(F.array(*map(F.lit, values)), F.pmod(_number(d, at), F.lit(len(values))).cast("int"))
        given = F.lower(F.when(gender == "f", choose(GIVEN[script]["f"], 0)).when(gender == "m", choose(GIVEN[script]["m"], 0)).otherwise(choose(GIVEN[script]["n"], 0)))
        surname = F.concat(*[choose(SYLLABLES[script], 6 * k) for k in (1, 2, 3)], F.when(draw > 0, F.concat(*[choose(SYLLABLES[script], 6 * k) for k in (4, 5)])).otherwise(""))
        # A middle initial stays one, and a third name is a second surname.
        second = F.get(F.split(name, " "), F.lit(1))
        middle = F.when(second.endswith("."), F.concat(_reshaped(second, F.substr(d, F.lit(100), F.lit(6)))))
        further = F.when(F.size(F.split(name, " ")) - F.when(middle.isNotNull(), 1).otherwise(0) > 2, F.concat(*[choose(SYLLABLES[script], 6 * k) for k in (6, 7, 8)]))
        return F.when(name.contains(" "), F.concat_ws(" ", given, middle, surname, further)).otherwise(surname)

    person = F.concat(gender, F.lit("|"), F.when(name.rlike(r"\p{IsCyrillic}"), named("cyrillic")).otherwise(named("latin")))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "ipv6", ipv6)
        .when(kind == "card", card)
        .when(kind == "phone", phone)
        .when(kind == "name", person)
        .when(kind == "iban", _reshaped(same, d, 2))
        .when(same.rlike("^[0-9a-f]+$"), _reshaped(same, d, 0, True))
        .otherwise(_reshaped(same, d, F.length(F.regexp_extract(same, "^(AKIA|eyJ|(?:sk|pk|ghp)[_-])", 1))))
    )


def _adding(array: Column, name: str, value: Callable[[Column], Column]) -> Column:
    """The array of structs with one more field. Each field is computed once, however often later ones use it."""
    return F.transform(array, lambda x: x.withField(name, value(x)))


def _with_surrogates(array: Column, key: str) -> Column:
    """The array of structs (kind, same, draw) with the field ``new``."""
    array = _adding(array, "d", lambda x: _stream(F.length(x["same"]), F.lit(key), x["kind"], x["same"], x["draw"].cast("string")))
    array = _adding(array, "shared", lambda x: F.when(x["kind"] == "email", _stream(F.length(x["same"]), F.lit(key), F.lit("domain"), F.substring_index(x["same"], "@", -1))))
    return _adding(array, "new", lambda x: surrogate_identity(x["kind"], x["same"], x["draw"], x["d"], x["shared"]))


def render(entity: Column, kind: Column, new: Column) -> Column:
    """The replacement as this mention is written: its case, spacing and title."""
    name = F.substr(new, F.lit(3), F.length(new))
    plain = F.regexp_replace(entity, _TITLE, "")
    return (
        F.when(kind.isin("card", "iban"), _into(entity, new))
        .when(kind == "phone", _phone(entity, new))
        .when(kind == "email", F.when(entity.rlike(r"\p{Ll}") | ~entity.rlike(r"\p{Lu}"), new).otherwise(F.upper(new)))
        .when(kind == "name", F.concat(F.regexp_extract(entity, f"({_TITLE})", 1), F.when(plain.rlike(r"\p{Ll}"), F.initcap(name)).otherwise(F.upper(name))))
        .otherwise(new)
    )


def _phone(shape: Column, new: Column) -> Column:
    places = F.transform(F.split(shape, ""), lambda c, i: F.when(c.rlike(r"[\d+]"), F.substr(new, F.length(F.regexp_replace(F.substr(shape, F.lit(1), i + 1), r"[^\d+]", "")), F.lit(1))).otherwise(c))
    return F.array_join(places, "")


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct entities of all texts, (kind, same): pre-aggregated on the map side, so common ones are no hot keys."""
    found = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))).alias("entity"))
    named = F.get(_named(F.array(F.struct(F.col("entity").alias("m")))), 0)
    return found.distinct().select(named.alias("x")).select("x.kind", "x.same").distinct()


def _named(array: Column) -> Column:
    """The array of structs (m: a mention) with the fields ``kind`` and ``same``."""
    array = _adding(array, "kind", lambda x: type_of(x["m"]))
    return _adding(array, "same", lambda x: identity(x["m"], x["kind"]))


def redraws(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, same, draw) of the entities whose first surrogate coincides with another's or with a real entity; draw tells which is free."""
    drawn = written(found.withColumn("draw", F.lit(0)), "entities")
    # From the written table: reading ``found`` again would search all texts again.
    real = drawn.select("kind", F.col("same").alias("new"))
    for _ in range(MAX_DRAWS):
        named = drawn.withColumn("new", F.get(_with_surrogates(F.array(F.struct("kind", "same", "draw")), key), 0)["new"])
        # Only the few entities of one surrogate meet in a window.
        place = F.row_number().over(W.partitionBy("kind", "new").orderBy("draw", "same"))
        clash = named.withColumn("place", place).join(real.withColumn("taken", F.lit(True)), ["kind", "new"], "left")
        again = (F.col("place") > 1) | F.col("taken").isNotNull()
        checked = written(clash.select("kind", "same", "draw", again.alias("again")), "entities")
        if checked.where("again").isEmpty():
            return drawn.where("draw > 0")
        drawn = checked.select("kind", "same", (F.col("draw") + F.col("again").cast("int")).alias("draw"))
    raise ValueError(f"no distinct surrogates after {MAX_DRAWS} draws")


def pseudonymise(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """The rows of ``docs`` with their entities replaced in ``text``, and ``n_entities`` (mentions replaced).

    Distinct entities get distinct surrogates, none of which is a real entity of ``docs``; mentions of one entity
    get the same in all documents. Null stays null, texts without entities stay as they are, repeated rows are each
    rewritten alike; all other columns are kept (one named n_entities gives way).
    """
    again = redraws(entities(docs, text), key)
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    docs = docs.withColumn("_mentions", _named(F.transform(found, lambda m: F.struct(m.alias("m")))))
    draw: Callable[[Column], Column] = lambda x: F.lit(0)
    if not again.isEmpty():
        # The few entities that needed a further draw meet the texts that hold them: one row per text and entity, then one map per text.
        name = lambda x: F.concat_ws("\u0001", x["kind"], x["same"])
        held = docs.where(F.size("_mentions") > 0).select(F.xxhash64(text).alias("_text"), F.explode(F.array_distinct(F.transform("_mentions", name))).alias("_name")).distinct()
        needed = again.select(F.concat_ws("\u0001", "kind", "same").alias("_name"), "draw")
        maps = held.join(needed, "_name").groupBy("_text").agg(F.map_from_entries(F.collect_list(F.struct("_name", "draw"))).alias("_draws"))
        docs = docs.withColumn("_text", F.xxhash64(text)).join(written(maps, "redraws"), "_text", "left").drop("_text")
        draw = lambda x: F.coalesce(F.element_at("_draws", name(x)), F.lit(0))
    new = _with_surrogates(_adding(F.col("_mentions"), "draw", draw), key)
    new = F.transform(new, lambda x: render(x["m"], x["kind"], x["new"]))
    joined = F.array_join(F.zip_with(F.split(text, PATTERN, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    replaced = F.when(F.size("_mentions") > 0, joined).otherwise(F.col(text))
    return docs.withColumns({text: replaced, "n_entities": F.coalesce(F.size("_mentions"), F.lit(0))}).drop("_mentions", "_draws")
