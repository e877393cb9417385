"""Keyed, type-consistent surrogates for personal data.

Entities are found by pattern.  Each distinct entity gets a surrogate that is a
function of a secret key: digits stay digits, letters keep case and script,
separators, lengths and check digits stay right, given names keep gender and
script.  A table of all distinct entities is checked for collisions, between
surrogates and with entities that really occur; the later one draws again until
none is left, after some lost draws from a wider space: one more letter or digit,
the next range of addresses.  The same entity has the same surrogate everywhere, different
ones never share one.

Texts without a possible entity pass in one narrow step; only the others meet
their surrogates in a shuffle.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.llm.catalog import query, table
from lethe.session import materialise

KEY = b"surrogates of the corpus"  # stands in for a secret; callers give their own
PATIENCE = 4  # so many lost draws widen the values an entity may get by one step

# Titles by gender, given names by script and gender (no names that are common words or places).
TITLES = {"m": ("Mr", "Herr", "Señor", "Sr", "Monsieur"), "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme"), "n": ("Dr", "Prof")}
GIVEN = {
    ("latin", "m"): tuple(
        "James John Robert Michael William David Thomas Peter Pierre Hans Carlos Richard Joseph Charles Christopher Daniel Matthew "
        "Anthony Donald Steven Stephen Andrew Paul Joshua Kenneth Kevin Brian George Timothy Ronald Edward Jason Jeffrey Ryan Jacob "
        "Nicholas Gary Eric Jonathan Larry Justin Scott Brandon Benjamin Samuel Gregory Alexander Patrick Raymond Dennis Jerry Tyler "
        "Aaron Jose José Adam Nathan Henry Douglas Zachary Kyle Walter Ethan Jeremy Harold Keith Roger Noah Gerald Terry Lawrence Sean "
        "Albert Joe Juan Jesse Willie Billy Bryan Bruce Ralph Roy Eugene Louis Philip Phillip Johnny Bobby Martin Oliver Simon Luke "
        "Jean Jacques Michel Philippe Alain Bernard André Nicolas François Julien Olivier Laurent Étienne Klaus Jürgen Wolfgang Karl "
        "Heinz Stefan Andreas Uwe Dieter Matthias Jörg Günther Fritz Otto Luis Miguel Javier Antonio Francisco Manuel Pedro Pablo Diego "
        "Jorge Fernando Alejandro Ricardo Giovanni Giuseppe Marco Luca Paolo Mario Jan Piotr Lars Erik Sven Mohammed Muhammad Ahmed Ali "
        "Omar Hassan Ibrahim Raj Amit Rahul Wei Hiroshi Kenji".split()
    ),
    ("latin", "f"): tuple(
        "Mary Patricia Jennifer Linda Elizabeth Anna Sophie Greta Marie Lucia Carmen Sarah Sara Barbara Susan Jessica Karen Lisa Nancy "
        "Betty Margaret Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Dorothy Melissa Deborah Stephanie Rebecca Sharon Laura "
        "Cynthia Kathleen Amy Angela Shirley Brenda Emma Pamela Nicole Helen Samantha Katherine Christine Debra Rachel Carolyn Janet "
        "Catherine Maria Heather Diane Ruth Julie Olivia Joyce Kelly Christina Joan Evelyn Lauren Judith Megan Andrea Cheryl Hannah "
        "Jacqueline Martha Gloria Teresa Ann Anne Jane Alice Kathryn Julia Sophia Isabella Amelia Claire Isabelle Nathalie Sylvie Camille "
        "Céline Hélène Françoise Monique Brigitte Ursula Ingrid Petra Sabine Monika Heike Katrin Renate Gisela Ana Isabel María Pilar "
        "Dolores Elena Rosa Lucía Francesca Giulia Chiara Katarzyna Agnieszka Fatima Aisha Priya Yuki".split()
    ),
    ("cyrillic", "m"): ("Иван", "Пётр", "Сергей", "Дмитрий", "Николай"),
    ("cyrillic", "f"): ("Мария", "Анна", "Ольга", "Елена", "Наталья"),
    ("greek", "m"): ("Γιώργος", "Νίκος", "Δημήτρης", "Κώστας"),
    ("greek", "f"): ("Μαρία", "Ελένη", "Κατερίνα", "Σοφία"),
}
# Letters from which new names are spelled: consonants and vowels of each script.
SPELLING = {
    "latin": ("bcdfghjklmnprstvwz", "aeiou"),
    "cyrillic": ("бвгджзклмнпрстфх", "аеиоу"),
    "greek": ("βγδζθκλμνπρστφχ", "αειου"),
}
ENDING = {("latin", "f"): "a", ("cyrillic", "f"): "а", ("greek", "f"): "α", ("greek", "m"): "ς"}

_LETTER = r"[^\W\d_]"
_SMALL = "".join(chr(i) for i in range(0x600) if chr(i).islower())
_CAP = rf"[^\W\d_{_SMALL}]"
_SPACE = r"[ \t\u00a0]{1,3}"
# One name: O'Brien and McDonald are one, the parts of Smith-Jones are two.
_PART = rf"(?:{_CAP}['’])?{_CAP}{_LETTER}+(?:['’]{_CAP}{_LETTER}+)*"
_NAME = rf"{_PART}(?:[-‐‑]{_PART})*"
_INITIALS = rf"(?:{_CAP}\.[ ]?){{1,3}}"
_PARTICLE = r"(?:von|van|de|der|den|del|della|di|da|dos|du|la|le|zu|ten|ter|bin|al)"
CAPITAL_TITLES = ("MR", "MRS", "DR", "PROF", "HERR", "FRAU")


def canonical(name: str) -> str:
    """One spelling of a name in capitals or not."""
    return "'".join(part.capitalize() for part in re.split("['’]", name))


GENDER_OF = {canonical(name): (script, gender) for (script, gender), names in GIVEN.items() for name in names}
TITLE_GENDER = {t: g for g, titles in TITLES.items() for t in titles}
TITLE_GENDER |= {t: TITLE_GENDER[t.capitalize()] for t in CAPITAL_TITLES}


def _any(words) -> str:
    """A pattern of whole words that looks at the first letter once."""
    by_first: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        by_first.setdefault(word[0], []).append(word[1:])
    return "(?:" + "|".join(f"{first}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for first, rest in by_first.items()) + ")"


_TITLE = _any(TITLE_GENDER)
_KNOWN = _any([*GENDER_OF, *(name.upper() for name in GENDER_OF)])

# Characters of an account number, by country.
IBAN_LENGTH = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL IQ", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT",
        26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT",
    }.items()
    for country in countries.split()
}

# Possible entities, in the order in which they claim text.
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"),
    ("card", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    (
        "phone",
        r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
        r"|(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
        r"|0[1-9](?:[ .-][0-9]{2}){4}|(?:\(0[0-9]{1,4}\)[ ]?|0[0-9]{1,4}[ /-])[0-9]{3,4}[ -]?[0-9]{3,4})(?![\w])",
    ),
    (
        "person",
        rf"\b(?:(?:{_TITLE}(?:\.|\.?{_SPACE}))+(?:(?:{_NAME}|{_PARTICLE}){_SPACE}|{_INITIALS}{_SPACE}|{_INITIALS}){{0,3}}{_NAME}"
        rf"|{_KNOWN}(?:[-‐‑]{_PART})*{_SPACE}(?:{_INITIALS}{_SPACE}|{_INITIALS}|{_PARTICLE}{_SPACE}|{_KNOWN}{_SPACE}){{0,3}}{_NAME}(?:{_SPACE}{_NAME})?)",
    ),
)
FINDER = "|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS)
# A text that this does not match holds no entity.
HINT = (
    r"(?=[(@0-9+A-ZÀ-ÞА-ЯЁΆ-Ω])(?:"  # at most places one look is enough
    r"@|[0-9]{13}|[0-9][ .)/-]+[0-9(]|[A-Z]{2}[0-9]{2}[ A-Z0-9]|\+[0-9]{5}|"
    + _TITLE + r"[. \t\u00a0]|" + _KNOWN + r"[ \t\u00a0‐‑-])"
)
# The parts of a person's name, and names alone with initials before them.
_WORDS = re.compile(rf"{_PART}|{_CAP}(?=\.)")
_BARE = re.compile(rf"(?<!\w)({_INITIALS})?(?:[ ]?)({_PART})(?!\w)")


def luhn(digits: str) -> int:
    """0 when the last digit is the right check digit."""
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def iban_rest(code: str) -> int:
    """1 when the check digits are right."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def iban_end(found: str) -> int:
    """Length of the longest start of `found` that ends with a token and has the right
    check digits, the country's own length before all others; 0 if there is none."""
    ends = [i for i in range(len(found), 0, -1) if found[i : i + 1] in ("", " ")]
    codes = [(end, code) for end in ends if len(code := found[:end].replace(" ", "")) >= 12]
    codes.sort(key=lambda c: len(c[1]) != IBAN_LENGTH.get(found[:2]))
    return next((end for end, code in codes if iban_rest(code) == 1), 0)


def script_of(word: str) -> str:
    """Latin, Cyrillic and Greek names are spelled anew; others ("") get letters of their own alphabet."""
    first = word[0]
    if "Ѐ" <= first <= "ӿ":
        return "cyrillic"
    if "Ͱ" <= first <= "Ͽ":
        return "greek"
    return "latin" if unicodedata.name(first, "").startswith("LATIN") else ""


@cache
def alphabet(letter: str) -> str:
    """Letters of the same script and kind near `letter`."""
    first, last = next((r for r in ((0x4E00, 0x9FA5), (0xAC00, 0xD7A3)) if r[0] <= ord(letter) <= r[1]), (ord(letter) & ~0xFF, ord(letter) | 0xFF))
    script = unicodedata.name(letter, "").split(" ")[0].split("-")[0]
    near = map(chr, range(first, last + 1))
    return "".join(c for c in near if unicodedata.category(c) == unicodedata.category(letter) and unicodedata.name(c, "").startswith(script)) or letter


@dataclass(frozen=True)
class Mention:
    """A stretch of text that stands for one entity."""

    start: int
    end: int
    kind: str
    entity: str
    initial: bool = False  # one letter that stands for the name


def mentions(text: str, finder: re.Pattern) -> list[Mention]:
    """All mentions in order.  A person's names are mentions of their own, so that a
    surname alone and the full name agree; a title gives the gender of unknown names.
    Once a text has a person, the names count wherever else they stand in it.
    What fails a check is searched again from its second character."""
    out, persons, after = [], [], 0
    while m := finder.search(text, after):
        kind, found, after = m.lastgroup, m[0], m.end()
        if kind == "person":
            persons.append(m.span())
            continue
        if kind == "iban":
            found = found[: iban_end(found)]
            after = m.start() + len(found)
        if not found or (kind == "ip" and max(map(int, found.split("."))) > 255):
            after = m.start() + 1
            continue
        entity = found.lower() if kind == "email" else found if kind == "ip" else re.sub(r"[^A-Z0-9]", "", found)
        out.append(Mention(m.start(), after, kind, entity))
    return sorted([*out, *_names(text, persons, out)], key=lambda m: m.start) if persons else out


def _names(text: str, persons: list[tuple[int, int]], others: list[Mention]) -> list[Mention]:
    """The names in `persons`, and the same names anywhere outside `others`."""
    parts, kinds = [], {}  # (start, end, kind and entity, or none for an initial)
    for start, end in persons:
        words = list(_WORDS.finditer(text, start, end))
        # the last name begins after the last blank
        last, gender = max(text.rfind(c, start, end) for c in " \t\u00a0."), "n"
        for w in words:
            name = canonical(w[0])
            title = TITLE_GENDER.get(w[0])
            if title:
                gender = title
            elif len(w[0]) == 1:
                parts.append((*w.span(), None))
            else:
                kind = "given_" + GENDER_OF[name][1] if name in GENDER_OF else "given_" + gender if gender != "n" and w.start() < last else "surname"
                kinds.setdefault(name, kind)
                parts.append((*w.span(), (kind, name)))
    taken = sorted([*persons, *((m.start, m.end) for m in others)])
    at = 0
    for w in _BARE.finditer(text):
        name = canonical(w[2])
        while at < len(taken) and taken[at][1] <= w.start(2):
            at += 1
        if name not in kinds or (at < len(taken) and taken[at][0] < w.end(2)):
            continue
        first = max(w.start(), taken[at - 1][1] if at else 0)
        parts += [(i, i + 1, None) for i in range(first, w.start(2)) if text[i].isalpha()]
        parts.append((*w.span(2), (kinds[name], name)))
    parts.sort(key=lambda p: p[:2])
    out, owner = [], None
    for start, end, what in reversed(parts):
        if what:
            owner = what
            out.append(Mention(start, end, *what))
        elif owner:  # a given name of the text with that initial, or the name that follows
            letter = text[start]
            given = next(((k, n) for n, k in kinds.items() if k != "surname" and n[0] == letter), owner)
            out.append(Mention(start, end, *given, initial=True))
    return out


Maker = Callable[["Stream", str, bytes, int], str]
# First numbers of addresses that are neither private nor kept for special use.
PUBLIC = [n for n in range(1, 224) if n not in (10, 100, 127, 169, 172, 192, 198)]


class Stream:
    """Numbers that depend on the key and what they are for, and on nothing else."""

    def __init__(self, key: bytes, *what: object):
        self.key, self.what, self.block, self.held = key, "\x1f".join(map(str, what)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.held) < 8:
            self.held += hmac.new(self.key, self.block.to_bytes(4, "big") + self.what, hashlib.sha256).digest()
            self.block += 1
        value, self.held = int.from_bytes(self.held[:8], "big"), self.held[8:]
        return value % n

    def digits(self, n: int, first: int = 0) -> str:
        return "".join(str(first + self.below(10 - first) if i == 0 else self.below(10)) for i in range(n))

    def like(self, text: str) -> str:
        """Letters for letters, digits for digits, everything else as it is."""
        return "".join(
            chr(97 + self.below(26)) if "a" <= c <= "z" else chr(65 + self.below(26)) if "A" <= c <= "Z" else str(self.below(10)) if c.isdigit() else c
            for c in text
        )

    def spelled(self, like: str, longer: int = 0) -> str:
        """A name like another in script, length and apostrophes, or so many letters longer."""
        script = script_of(like)
        if not script:
            return "".join(alphabet(c)[self.below(len(alphabet(c)))] if c.isalpha() else c for c in like + longer * like[-1])
        at, letters = like.find("'"), self.name(script, max(3, len(like) - like.count("'")) + longer, "")
        return letters if at < 0 else letters[:at] + "'" + letters[at:].capitalize()

    def name(self, script: str, length: int, ending: str) -> str:
        consonants, vowels = SPELLING[script]
        start = self.below(2)
        letters = [(consonants, vowels)[(i + start) % 2] for i in range(max(3, length - len(ending)))]
        return ("".join(pool[self.below(len(pool))] for pool in letters) + ending).capitalize()


# Makers take a `step`: how often the space was widened.  It grows without end, so
# every entity gets a surrogate in the end, longer than itself where it must be.


def _email(s: Stream, entity: str, key: bytes, step: int) -> str:
    local, _, domain = entity.partition("@")
    host, _, top = domain.rpartition(".")
    return f"{s.like(local + 'a' * step)}@{Stream(key, 'domain', domain).like(host)}.{top}"


def _card(s: Stream, entity: str, key: bytes, step: int) -> str:
    body = s.digits(len(entity) + step, 1)
    if luhn(entity):
        return body
    return next(body[:-1] + str(d) for d in range(10) if luhn(body[:-1] + str(d)) == 0)


def _iban(s: Stream, entity: str, key: bytes, step: int) -> str:
    account = s.like(entity[4:] + "0" * step)
    return f"{entity[:2]}{98 - iban_rest(entity[:2] + '00' + account):02d}{account}"


def _ip(s: Stream, entity: str, key: bytes, step: int) -> str:
    first, second = entity.split(".")[:2]
    own = (first,) if first == "10" else (first, second) if (first, second) in (("192", "168"), ("127", "0")) else ()
    wider = {"192": (("172", str(16 + s.below(16))), ("10",)), "127": (("127",),)}.get(first, ()) if own else ()
    if step > len(wider) + 1:  # more addresses than IPv4 has room for
        return "fd" + ":".join(f"{s.below(65536):04x}" for _ in range(8))[2:]
    head = (own, *wider)[step] if step <= len(wider) else None
    if not head:
        few = step == 0
        head = (str((11, 23, 45, 67, 81, 93, 109, 151, 178, 203)[s.below(10)] if few else PUBLIC[s.below(len(PUBLIC))]),)
    low, high = (1, 254) if step == 0 else (0, 256)
    return ".".join([*head, *(str(low + s.below(high)) for _ in range(4 - len(head)))])


def _phone(s: Stream, entity: str, key: bytes, step: int) -> str:
    country = max(entity.startswith("0"), len(entity) - 10)  # the digits before the last ten stay
    return entity[:country] + s.digits(len(entity) - country + step, 2)


def _given(gender: str) -> Maker:
    def make(s: Stream, entity: str, key: bytes, step: int) -> str:
        script = script_of(entity)
        known = GIVEN.get((script, gender), ())
        pick = s.below(3 * max(1, len(known)))
        if pick < len(known) and not step:
            return known[pick]
        if (script, gender) in ENDING and "'" not in entity:
            return s.name(script, max(3, len(entity)) + step, ENDING[script, gender])
        return s.spelled(entity, step)

    return make


MAKERS: dict[str, Maker] = {
    "email": _email,
    "iban": _iban,
    "ip": _ip,
    "card": _card,
    "ssn": lambda s, e, k, step: s.digits(9 + step, 1),
    "phone": _phone,
    "given_m": _given("m"),
    "given_f": _given("f"),
    "surname": lambda s, e, k, step: s.spelled(e, step),
}


def surrogate(kind: str, entity: str, attempt: int, key: bytes) -> str:
    return MAKERS[kind](Stream(key, kind, entity, attempt), entity, key, attempt // PATIENCE)


def in_format(found: str, replacement: str) -> str:
    """`replacement` (letters and digits only) laid over the letters and digits of `found`,
    what it has more behind the last."""
    spare = iter(replacement)
    return "".join([*(next(spare) if c.isalnum() else c for c in found), *spare])


def _cased(name: str, found: str) -> str:
    """`name` in capitals where `found` is, with its apostrophe."""
    name = name.upper() if found.isupper() else name
    return name.replace("'", "’") if "’" in found else name


def _name_space(kind: str) -> str:
    """Kinds whose surrogates must differ from each other."""
    return "name" if kind.startswith(("given", "surname")) else kind


def assign(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, entity, surrogate) for distinct (kind, entity): keyed, pairwise different
    within a kind (all names count as one), and never an entity of the table.

    Those that lost a collision draw again; the earlier attempt, then the smaller
    entity, stays.  Lost draws widen the space, so that the rounds end.
    """

    def draw(batches):
        for batch in batches:
            made = [surrogate(k, e, a, key) for k, e, a in zip(batch["kind"], batch["entity"], batch["attempt"])]
            yield batch[["kind", "entity", "attempt"]].assign(space=[_name_space(k) for k in batch["kind"]], surrogate=made)

    fields = "kind string, entity string, attempt int, space string, surrogate string"
    now = materialise(entities.select("kind", "entity", F.lit(0).alias("attempt")).mapInPandas(draw, fields), "surrogates")
    real = materialise(now.select("space", F.col("entity").alias("surrogate")).distinct(), "real-entities")
    while True:
        first = now.groupBy("space", "surrogate").agg(F.min(F.struct("attempt", "entity", "kind")).alias("first"))
        taken = real.withColumn("real", F.lit(True))
        judged = now.join(first, ["space", "surrogate"]).join(taken, ["space", "surrogate"], "left")
        lost = F.col("real").isNotNull() | (F.col("first") != F.struct("attempt", "entity", "kind"))
        judged = materialise(judged.select("kind", "entity", "attempt", "space", "surrogate", lost.alias("lost")), "judged")
        losers = judged.where("lost")
        if losers.isEmpty():
            return now.select("kind", "entity", "surrogate")
        again = losers.select("kind", "entity", (F.col("attempt") + 1).alias("attempt")).mapInPandas(draw, fields)
        now = materialise(judged.where("NOT lost").drop("lost").unionByName(again), "surrogates")


def _lister(batches):
    finder = re.compile(FINDER)
    for batch in batches:
        rows = [(h, k, e) for h, text in zip(batch["h"], batch["text"]) for k, e in sorted({(m.kind, m.entity) for m in mentions(text, finder)})]
        yield pd.DataFrame(rows, columns=["h", "kind", "entity"])


def rewrite(text: str, known: dict[tuple[str, str], str], finder: re.Pattern) -> str:
    out, at = [], 0
    for m in mentions(text, finder):
        made, found = known[m.kind, m.entity], text[m.start : m.end]
        if _name_space(m.kind) == "name":
            made = _cased(made[0 if m.kind != "surname" else -1].upper() if m.initial else made, found)
        elif m.kind not in ("email", "ip"):
            made = in_format(found, made)
        out += [text[at : m.start], made]
        at = m.end
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def _rewritten(text: pd.Series, kinds: pd.Series, entities: pd.Series, made: pd.Series) -> pd.Series:
    finder = re.compile(FINDER)
    return pd.Series(
        [t if k is None else rewrite(t, dict(zip(zip(k, e), s)), finder) for t, k, e, s in zip(text, kinds, entities, made)]
    )


def replace_entities(docs: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """The rows and columns of `docs`, entities in `text_col` replaced, and
    `n_entities` (bigint): the distinct entities of the text.

    Null texts stay null and have none; empty texts and texts without entities
    are unchanged.  Copies of a text are looked at once and get the same
    surrogates.  All other columns are carried along; an own column called
    `n_entities` is replaced; an empty table gives an empty table.
    """
    columns = [c for c in docs.columns if c != "n_entities"]
    hinted = F.coalesce(F.col(text_col).rlike(HINT), F.lit(False))
    plain = docs.where(~hinted).select(*columns, F.lit(0).cast("bigint").alias("n_entities"))
    marked = docs.where(hinted).select(*columns, F.unhex(F.sha2(F.col(text_col), 256)).alias("_text_hash"))
    found = materialise(
        marked.select(F.col("_text_hash").alias("h"), F.col(text_col).alias("text"))
        .mapInPandas(_lister, "h binary, kind string, entity string")
        .distinct(),
        "entities",
    )
    chosen = assign(found.select("kind", "entity").distinct(), key)
    # as many as the text has distinct entities
    per_text = (
        found.join(chosen, ["kind", "entity"])
        .groupBy("h")
        .agg(F.collect_list(F.struct("kind", "entity", "surrogate")).alias("_swaps"))
        .withColumnRenamed("h", "_text_hash")
    )
    swapped = _rewritten(F.col(text_col), F.col("_swaps.kind"), F.col("_swaps.entity"), F.col("_swaps.surrogate"))
    met = marked.join(per_text, "_text_hash", "left").select(
        *[swapped.alias(c) if c == text_col else F.col(c) for c in columns],
        F.coalesce(F.size("_swaps"), F.lit(0)).cast("bigint").alias("n_entities"),
    )
    return plain.unionByName(met)


@query("op2_surrogates")
def surrogates(spark, sf_dir):
    return replace_entities(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")
