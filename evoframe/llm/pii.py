"""Personal data replaced by keyed surrogates of the same type and format.

One pattern finds the entities of a text from left to right: names after a title, mail
addresses, access tokens, bank accounts, network addresses, card, phone and social
security numbers. Each distinct value gets one surrogate for the whole corpus, drawn from
a keyed hash: digits become digits and letters letters of the same case, separators stay,
card and account numbers keep valid check digits, mail addresses go to reserved domains,
those of one domain to one.
A name is its surname and its given name, each with a surrogate of its own of the same
script, the given name of the gender that its title tells; title and case stay. So
``Mr Smith``, ``Mr. SMITH`` and ``Mr John Smith`` keep one surname. Equal values stay
equal, and a table of all distinct values, made before any text is changed, is checked so
that different values stay different: where two surrogates are equal, or one is a value
of the corpus, the hash is drawn again for all but one.

Only DataFrame and SQL functions are used. Each text is cut at its entities and put
together again, so nothing is replaced inside another match.

Defined results: null texts stay null; texts without entities, empty and very long ones
pass unchanged but for their entities; a null ``doc_id`` and repeated rows are handled row
by row; all other columns are passed on, whatever their names; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoframe.llm._common import materialize, packed

KEY = "evoframe-surrogates-1"
#: Draws that keep the format; a format with fewer forms than the corpus has values needs more.
LAST_IN_FORMAT = 30

#: Titles by the gender they tell.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Madame", "Señora", "Señorita", "Sra", "Srta", "Doña", "Г-жа", "Госпожа"),
    "m": ("Mr", "Herr", "M", "Monsieur", "Señor", "Sr", "Don", "Г-н", "Господин"),
    "n": ("Dr", "Prof"),
}

#: Surrogate given names and surnames by script and gender.
NAMES = {
    "latin": {
        "f": ("Alma", "Berta", "Clara", "Dora", "Elsa", "Flora", "Greta", "Hanna", "Irma", "Jana", "Klara", "Lena", "Marta", "Nora", "Olga", "Paula"),
        "m": ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Max", "Noah", "Oscar", "Paul"),
        "n": ("Alex", "Ariel", "Casey", "Dana", "Eden", "Francis", "Jamie", "Jules", "Kim", "Lee", "Luca", "Noel", "Robin", "Sam", "Sascha", "Toni"),
        "last": ("Abel", "Berg", "Corden", "Dahl", "Ekman", "Falk", "Grant", "Holm", "Iversen", "Jansen", "Keller", "Lind", "Marek", "Norden", "Olsen", "Petri"),
    },
    "cyrillic": {
        "f": ("Анна", "Вера", "Дарья", "Елена", "Зоя", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Раиса", "София", "Тамара", "Ульяна", "Юлия", "Яна"),
        "m": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Тимур"),
        "n": ("Валя", "Женя", "Нюся", "Паша", "Саша", "Слава", "Тося", "Шура", "Ася", "Боря", "Витя", "Геля", "Дуня", "Лёля", "Муся", "Вася"),
        "last": ("Абрамец", "Бойко", "Вольных", "Гуд", "Долгих", "Ернык", "Живаго", "Зима", "Ильюх", "Коваль", "Лысенко", "Мороз", "Нечай", "Орлик", "Панько", "Рудь"),
    },
    "greek": {
        "f": ("Άννα", "Δάφνη", "Ελένη", "Ζωή", "Θάλεια", "Κλειώ", "Λήδα", "Νίκη"),
        "m": ("Άρης", "Βίκτωρ", "Ηλίας", "Θωμάς", "Κώστας", "Λουκάς", "Μάρκος", "Πέτρος"),
        "n": ("Αλέξ", "Ντάνι", "Πάτι", "Ρόμπι", "Σάσα", "Τόνι", "Φράνσις", "Χάρις"),
        "last": ("Βέργος", "Γκίκας", "Δούκας", "Ζέρβας", "Κόκκινος", "Λάσκος", "Μελάς", "Ράλλης"),
    },
}
#: Letters that make surrogate names distinct, by script.
TAILS = {"latin": "aeiounrstlmdaeio", "cyrillic": "аеиоунрстлмдаеио", "greek": "αειουνρστλμδαειο"}

_WORD = r"\p{Lu}[\p{L}'’-]*\p{L}"
_INITIALS = "".join(sorted({t[0] for group in TITLES.values() for t in group}))
_TITLE = "|".join(sorted((t for group in TITLES.values() for t in group), key=lambda t: (-len(t), t)))

#: What is found, in order of preference where two begin at the same place.
KINDS = {
    "name": rf"(?<![\p{{L}}\p{{N}}])(?=[{_INITIALS}])(?:{_TITLE})\.?[ \u00a0]{_WORD}(?:[ \u00a0]{_WORD})?",
    # a domain has 127 labels at most; without a bound the matcher would recurse once for each
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,125}\.[A-Za-z]{2,}",
    "token": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,}|(?=[a-fA-F]*[0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,}))(?![A-Za-z0-9])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "address": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "security": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])",
    # a leading +, an area in brackets, or three groups
    "phone": (
        r"(?<![A-Za-z0-9+.])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
        r"|\([0-9]{2,4}\)[ .-]?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}"
        r"|[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4})(?![A-Za-z0-9])"
    ),
}
_WORD_START, _DIGIT = r"(?<![A-Za-z0-9])", r"(?=[0-9])"


def _any_of(*kinds: str) -> str:
    return "(?:" + "|".join(f"(?:{KINDS[k]})" for k in kinds) + ")"


#: All kinds in their order. What none of a group can begin with is ruled out once for the group, so most places cost one test.
PATTERN = "|".join((
    _WORD_START + _any_of("name", "mail", "token", "account"),
    _DIGIT + _any_of("address", "security"),
    _WORD_START + "(?=[0-9+(])" + _any_of("card", "phone"),
))
#: No entity is without one of these, and most texts have none.
_HINT = rf"[0-9@]|AKIA|gh[pousr]_|sk-|(?<![\p{{L}}\p{{N}}])(?=[{_INITIALS}])(?:{_TITLE})\.?[ \u00a0]\p{{Lu}}"


def entities(text: Column) -> Column:
    """The entities of a text, from left to right; none for null."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none)


def kind_of(value: Column) -> Column:
    """The type of a value that the pattern found."""
    tests = [F.when(value.rlike(rf"^(?:{p})$"), F.lit(kind)) for kind, p in KINDS.items()]
    return F.coalesce(*tests, F.lit("phone"))


def _digest(key: str, kind: Column, value: Column, salt: Column) -> Column:
    """128 hex digits of a keyed hash, the key on either side of the message."""
    message = F.concat_ws("\x1f", F.lit(key), kind, salt.cast("string"), value, F.lit(key))
    return F.sha2(message, 512)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _nibble(digest: Column, at: Column) -> Column:
    """A number from 0 to 255 at a place that wraps around."""
    return F.conv(F.substr(digest, at * 2 % 126 + 1, F.lit(2)), 16, 10).cast("int")


def _rewritten(value: Column, digest: Column) -> Column:
    """Digits for digits, letters for letters of the same case; other characters stay."""

    def pick(letters: str, n: Column) -> Column:
        return F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))

    # long values get further digests, so that no part repeats; the value is cut up once, so its length costs no more than itself
    def each(c: Column, i: Column) -> Column:
        block = F.when(i < 63, digest).otherwise(F.sha2(F.concat(digest, F.floor(i / 63).cast("string")), 512))
        n = _nibble(block, i)
        return (
            F.when(c.rlike("[0-9]"), pick("0123456789", n))
            .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", n))
            .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), each), "")


def _hex(value: Column, digest: Column) -> Column:
    """As ``_rewritten`` for hexadecimal digits, in the value's case."""
    longer = F.concat(digest, *[F.sha2(F.concat(digest, F.lit(str(k))), 512) for k in range(1, 4)])
    made = F.substr(F.repeat(longer, 1 + F.floor(F.length(value) / 512).cast("int")), F.lit(1), F.length(value))
    return F.when(value.rlike("[A-F]"), F.upper(made)).otherwise(made)


def _card(value: Column, digest: Column) -> Column:
    """Other digits in the same groups, with a valid last digit by Luhn's rule."""
    made = _rewritten(value, digest)
    digits = F.regexp_replace(made, "[^0-9]", "")
    n = F.length(digits)

    def doubled(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0), lambda a, i: a + doubled(i))
    check = ((10 - total % 10) % 10).cast("string")
    return F.concat(F.substr(made, F.lit(1), F.length(made) - 1), check)


def _mail(value: Column, digest: Column, key: str) -> Column:
    """Addresses of one domain, whatever its case, stay at one domain."""
    local, domain = F.substring_index(value, "@", 1), F.lower(F.substring_index(value, "@", -1))
    new = F.conv(F.substr(_digest(key, F.lit("domain"), domain, F.lit(0)), F.lit(1), F.lit(15)), 16, 10)
    return F.concat(_rewritten(local, digest), F.lit("@mail"), new, F.lit(".example.org"))


def _address(digest: Column) -> Column:
    first = _nibble(digest, F.lit(3)) % 15 + 240  # reserved, so no one's
    return F.concat_ws(".", *[p.cast("string") for p in (first, *(_nibble(digest, F.lit(i)) for i in range(3)))])


def _account(value: Column, digest: Column) -> Column:
    """The country stays; the check digits are right for the new number."""
    country, rest = F.substring(value, 1, 2), _rewritten(F.substr(value, F.lit(5), F.length(value)), digest)
    letters = F.split(F.concat(F.replace(rest, F.lit(" "), F.lit("")), country, F.lit("00")), "")

    def more(left: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (left * 10 + c.cast("int")) % 97).when(c.rlike("[A-Z]"), (left * 100 + F.ascii(c) - 55) % 97).otherwise(left)

    check = 98 - F.aggregate(letters, F.lit(0), more)
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), rest)


#: Kinds of the parts of names: a surname, and given names by gender.
NAME_KINDS = ("last", "f", "m", "n")


def _name_part(kind: Column, value: Column, digest: Column, salt: Column) -> Column:
    """A lower-case name for a lower-case one of the same script."""

    def made(script: str) -> Column:
        def pick(names: tuple[str, ...]) -> Column:
            return F.get(F.array(*map(F.lit, names)), _nibble(digest, F.lit(1)) % len(names))

        lists = NAMES[script]
        name = F.coalesce(*[F.when(kind == k, pick(lists[k])) for k in NAME_KINDS])
        # further letters keep distinct names distinct, the more the more often a name was drawn
        length = F.when(kind == "last", F.lit(4)).otherwise(F.lit(2)) + salt * 2
        return F.lower(F.concat(name, F.translate(F.substr(digest, F.lit(9), length), "0123456789abcdef", TAILS[script])))

    return F.when(value.rlike(r"\p{IsCyrillic}"), made("cyrillic")).when(value.rlike(r"\p{IsGreek}"), made("greek")).otherwise(made("latin"))


def _title(value: Column) -> Column:
    return F.regexp_extract(value, rf"^(?:{_TITLE})\.?[ \u00a0]", 0)


def _words(value: Column) -> Column:
    """The words of a name after its title."""
    return F.split(F.substr(value, F.length(_title(value)) + 1, F.length(value)), r"[ \u00a0]")


def parts_of(kind: Column, value: Column) -> Column:
    """What of a found value has a surrogate of its own, as ``kind, value``: a name's surname and given name, else all of it."""
    bare = F.regexp_replace(_title(value), r"[. \u00a0]", "")
    gender = F.when(bare.isin(*TITLES["f"]), F.lit("f")).when(bare.isin(*TITLES["m"]), F.lit("m")).otherwise(F.lit("n"))
    words = F.transform(_words(value), F.lower)
    last = F.struct(F.lit("last").alias("kind"), F.element_at(words, -1).alias("value"))
    given = F.struct(gender.alias("kind"), F.element_at(words, 1).alias("value"))
    whole = F.array(F.struct(kind.alias("kind"), value.alias("value")))
    return F.when(kind == "name", F.when(F.size(words) > 1, F.array(last, given)).otherwise(F.array(last))).otherwise(whole)


def _put_together(kind: Column, value: Column, news: Column) -> Column:
    """A found value's replacement from the surrogates of its parts; names in the case of the words they stand for."""

    def cased(new: Column, old: Column) -> Column:
        return F.when((old == F.upper(old)) & (F.length(old) > 1), F.upper(new)).otherwise(F.initcap(new))

    words = _words(value)
    last, given = cased(news[0], F.element_at(words, -1)), cased(F.get(news, F.lit(1)), F.element_at(words, 1))
    name = F.when(F.size(words) > 1, F.concat(given, F.lit(" "), last)).otherwise(last)
    return F.when(kind == "name", F.concat(_title(value), name)).otherwise(news[0])


def surrogate(kind: Column, value: Column, salt: Column, key: str = KEY) -> Column:
    """The replacement of a value for one draw. From draw ``LAST_IN_FORMAT`` on, further digits follow it."""
    prefix = r"^(?:AKIA|gh[pousr]_|sk-)"
    country = r"^\+[0-9]{1,3}"

    def after(pattern: str, digest: Column) -> Column:
        return F.concat(F.regexp_extract(value, pattern, 0), _rewritten(F.regexp_replace(value, pattern, ""), digest))

    def made(digest: Column) -> Column:
        new = (
            F.when(kind.isin(*NAME_KINDS), _name_part(kind, value, digest, salt))
            .when(kind == "mail", _mail(value, digest, key))
            .when(kind == "address", _address(digest))
            .when(kind == "card", _card(value, digest))
            .when((kind == "token") & value.rlike("^[0-9a-fA-F]+$"), _hex(value, digest))
            .when(kind == "token", after(prefix, digest))
            .when(kind == "account", _account(value, digest))
            .when(kind == "phone", after(country, digest))
            .otherwise(_rewritten(value, digest))
        )
        return F.when(salt < LAST_IN_FORMAT, new).otherwise(F.concat(new, F.lit("-"), F.substr(digest, F.lit(1), F.lit(32))))

    return _let(_digest(key, kind, value, salt), made)


def _marked(docs: DataFrame, column: str) -> DataFrame:
    """``row, own, found``: each row, a number of its own and its entities, written once, since finding them is the costly part."""
    found = entities(F.col("row").getField(column))
    return materialize(packed(docs).select("row", F.monotonically_increasing_id().alias("own"), found.alias("found")))


def _values(marked: DataFrame) -> DataFrame:
    """``value, kind``: every distinct entity of the corpus."""
    values = marked.select(F.explode(F.array_distinct("found")).alias("value")).distinct()
    return values.withColumn("kind", kind_of(F.col("value")))


def surrogates(values: DataFrame, key: str = KEY) -> DataFrame:
    """``kind, value, surrogate``: no two surrogates are equal, and none is itself a value.

    Draws are repeated only for values whose surrogate is taken: the one with the smallest
    (draw, kind, value) keeps it. The number of rounds does not follow the number of values:
    after ``LAST_IN_FORMAT`` draws a surrogate is 128 bits longer, and so distinct.
    """
    values = materialize(values.select("kind", "value"))
    drawn = materialize(values.select("kind", "value", F.lit(0).alias("salt"), surrogate(F.col("kind"), F.col("value"), F.lit(0), key).alias("surrogate")))
    real = values.select(F.col("value").alias("surrogate"), F.lit(True).alias("is_value")).distinct()
    while True:
        order = Window.partitionBy("surrogate").orderBy("salt", "kind", "value")
        seen = drawn.join(real, "surrogate", "left").withColumn("nth", F.row_number().over(order))
        again = seen.where((F.col("nth") > 1) | F.col("is_value").isNotNull())
        if again.isEmpty():
            return drawn.select("kind", "value", "surrogate")
        again = again.select("kind", "value", (F.col("salt") + 1).alias("salt"))
        redrawn = again.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("salt"), key))
        kept = drawn.join(again.select("kind", "value"), ["kind", "value"], "left_anti")
        drawn = materialize(kept.unionByName(redrawn.select(*kept.columns)))


def replacements(values: DataFrame, key: str = KEY) -> DataFrame:
    """``value, surrogate`` for every distinct entity ``value, kind``, from the surrogates of its parts."""
    parts = materialize(values.select("value", "kind", F.posexplode(parts_of(F.col("kind"), F.col("value"))).alias("at", "part")))
    table = surrogates(parts.select("part.*").distinct(), key).select(F.struct("kind", "value").alias("part"), "surrogate")
    news = F.transform(F.array_sort(F.collect_list(F.struct("at", "surrogate"))), lambda s: s.surrogate)
    found = parts.join(table, "part").groupBy("value", "kind").agg(news.alias("news"))
    return found.select("value", _put_together(F.col("kind"), F.col("value"), F.col("news")).alias("surrogate"))


def _changed(marked: DataFrame, key: str, column: str) -> DataFrame:
    """``marked`` with ``text``, each row's new text."""
    table = replacements(_values(marked), key)
    some = F.size("found") > 0
    places = marked.where(some).select("own", F.explode(F.array_distinct("found")).alias("value"))
    pairs = places.join(table, "value").groupBy("own").agg(F.map_from_entries(F.collect_list(F.struct("value", "surrogate"))).alias("new"))

    # the text is cut at its entities and put together again
    gaps = F.split(F.col("row").getField(column), PATTERN, -1)
    news = F.transform("found", lambda v: F.element_at(F.col("new"), v))
    whole = F.array_join(F.flatten(F.zip_with(gaps, news, lambda g, n: F.array(g, F.coalesce(n, F.lit(""))))), "")
    hit = marked.where(some).join(pairs, "own").select("row", "found", whole.alias("text"))
    return marked.where(~some).select("row", "found", F.col("row").getField(column).alias("text")).unionByName(hit)


def replace_pii(docs: DataFrame, key: str = KEY, column: str = "text") -> DataFrame:
    """``docs`` with every entity of ``column`` replaced, other columns as they are."""
    changed = _changed(_marked(docs, column), key, column)
    return changed.select(*[F.col("text").alias(c) if c == column else F.col("row").getField(c).alias(c) for c in docs.columns])


def pii_digest(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``doc_id, text, n_entities``: each document's new text and how many entities it had."""
    changed = _changed(_marked(docs.select("doc_id", F.col("text").cast("string").alias("text")), "text"), key, "text")
    return changed.select(F.col("row.doc_id").alias("doc_id"), "text", F.size("found").cast("long").alias("n_entities"))
