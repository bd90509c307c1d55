"""Personal data: detection and keyed surrogates.

Detected entities get replacements of the same type, script and format, drawn by an HMAC of the normalised value under a
secret key, so that equal entities get equal surrogates everywhere (coreference). A person's given name keeps its gender. The
distinct entities of the whole table are checked for collisions: a surrogate that two entities drew, or that is itself an
entity of the table, is drawn anew for all but one, until all are distinct. Only the number of the draw is kept, and only where
it is not the first; the surrogate itself is drawn again wherever the entity stands.

Persons are found after a title (``Dr. Alice Brown and Bob Stone``: the names joined to the first by commas or a word for *and*
too) or by a known given name before a family name. Names without either stay.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.store import cut, join_sized, own_columns, small_batches, with_fields
from folio.llm.textops import chunks

MALE_TITLES = frozenset("Mr Sir Lord Herr Monsieur Señor Sr Don Signor Господин Κύριος Κύριε".split())
FEMALE_TITLES = frozenset("Mrs Ms Miss Lady Madam Frau Fräulein Madame Mme Mlle Señora Señorita Sra Srta Doña Signora Госпожа Κυρία".split())
OTHER_TITLES = frozenset("Dr Prof Professor Dra Docteur Доктор Профессор Δρ".split())
# Given names that are no common words, by gender.
MALE_NAMES = frozenset(
    "Adam Alan Albert Alexander Andreas Andrew Anthony Antoine Bob Brian Carlos Charles Christopher Daniel David Diego Dmitri Edward Enrique Eric Fernando Francisco François Friedrich Gary George Gerhard Hans "
    "Harold Heinrich Ivan Jacques James Javier Jean Jeffrey Jens Johann John Jorge José Joseph Juan Jürgen Kenneth Kevin Klaus Luis Luka Manuel Michael Miguel Nicolas Nikolai Patrick Pedro Peter Philippe Pierre "
    "Rafael Raymond Richard Robert Ronald Sergei Stefan Stephen Steven Thomas Timothy Tomás Vladimir Walter William Wolfgang Алексей Андрей Владимир Дмитрий Иван Михаил Николай Сергей Γιώργος Νίκος".split()
)
FEMALE_NAMES = frozenset(
    "Agnes Alice Amanda Amélie Andrea Angela Anja Anna Barbara Beatriz Brigitte Camille Carmen Carolina Catherine Chantal Christine Claudia Cristina Deborah Diana Dorothy Elena Elisabeth Elizabeth Emily "
    "Fatima Françoise Gabriela Hannah Heidi Helena Ingrid Isabelle Jennifer Jessica Joanna Julia Karen Katharina Laura Linda Lucía Margaret Maria Marie María Martina Mary Michelle Monika Nancy Natalia Nathalie "
    "Nicole Olga Patricia Petra Rachel Rebecca Sabine Samantha Sandra Sarah Silvia Sophie Stephanie Susan Svetlana Teresa Ursula Valérie Yolanda Анна Екатерина Елена Мария Наталья Ольга Светлана Татьяна Μαρία Ελένη".split()
)
_NAME = r"[^\W\d_][^\W\d_]*(?:[-'’][^\W\d_]+)*"
TITLES = MALE_TITLES | FEMALE_TITLES | OTHER_TITLES


def any_of(words: frozenset[str]) -> str:
    """A pattern for any of the words, the longest first, told apart by their first two characters."""
    heads = {w[:2] for w in words}
    rest = lambda h: "|".join(sorted((w[2:] for w in words if w[:2] == h), key=lambda t: (-len(t), t)))
    seconds = lambda f: "|".join(f"{h[1:]}(?:{rest(h)})" for h in sorted(heads) if h[0] == f)
    return "|".join(f"{f}(?:{seconds(f)})" for f in sorted({h[0] for h in heads}))


_TITLES, _GIVEN = any_of(TITLES), any_of(MALE_NAMES | FEMALE_NAMES)
#: Only texts that match this are looked at (Java's dialect, evaluated by Spark): a cue of each of PATTERNS, behind its first characters where it is long.
HINT = (
    r"[\p{Nd}@]|:[A-Fa-f]{1,4}:|(?=[pPsStTaA\u017F])(?iu:passw|pwd|secret|token|(?:api|access|private)[_-]?key)"
    r"|(?=[Ags])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20})"
    rf"|(?=[\p{{Lu}}])(?<![\p{{L}}\p{{N}}_])(?:(?:{_TITLES})\.? |(?:{_GIVEN}) [\p{{Lu}}])"
)

PATTERNS = [
    ("email", re.compile(r"(?<![A-Za-z0-9À-ɏ_.+%-])[A-Za-z0-9À-ɏ][A-Za-z0-9À-ɏ._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}\b")),
    ("secret", re.compile(r"""\b(?i:passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)["']?\s*(?:=|:)\s*(?:"([^"\n]{4,200})"|'([^'\n]{4,200})'|["']?([^\s"']{7,}[^\s"'.,;:!?)\]}]))""")),
    ("secret", re.compile(r"\b((?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})\b")),
    ("iban", re.compile(r"\b(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?)\b")),
    ("ip", re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)")),
    ("ip6", re.compile(r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{0,39}::)[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]{2,35}[0-9A-Fa-f])(?![\w:])")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("card", re.compile(r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d])")),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .\-]?\(?\d{1,4}\)?){2,5}(?!\d)|(?<![\w(])\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d\-.])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])|(?<!\d )(?<![\w.,+\-/])\d{3} \d{3} \d{4}(?![\w\-]|[ .,]\d)|(?<![\w.,+\-/])0[1-9]\d{0,3}[ /\-]\d{4,8}(?![\w\-]|[ .,]\d)")),
    ("person", re.compile(rf"\b(?:({_TITLES})\b\.?[ ])+(?=[^\W\d_])({_NAME}(?:[ ]{_NAME}){{0,2}})")),
    ("person", re.compile(rf"\b({_GIVEN})[ ](?=[^\W\d_])({_NAME}(?:[ ]{_NAME})?)")),
]

#: Before four numbers that name a version.
_VERSION = re.compile(r"(?i:\b(?:version|ver|release|build|firmware)[ .:]*|\bv\.? ?)\Z")
#: Between the names of persons told one after another.
_NEXT = re.compile(rf"(?:, (?:and |und |et |y |и )?| and | und | et | y | и | και )(?=[^\W\d_])({_NAME}(?:[ ]{_NAME}){{1,2}})")

# Fixed pools of surrogate names by script and gender; a name whose gender is not told draws from both.
GIVEN = {
    ("latin", "f"): "Alma Berta Clara Dora Edith Flora Greta Hanna Ida Judith Klara Lotte Mira Nora Olga Paula Rita Selma Thea Ursula Vera Wanda Xenia Yvette Zita".split(),
    ("latin", "m"): "Albert Bruno Carl Denis Emil Felix Georg Hugo Igor Julius Karl Leo Martin Nils Oskar Paul Rolf Simon Theo Ulrich Viktor Walter Xaver Yann Zeno".split(),
    ("greek", "f"): "Άννα Βασιλική Γεωργία Δήμητρα Ειρήνη Ζωή Θάλεια Ιωάννα Κατερίνα Λυδία Μελίνα Ναταλία Ξένια Ολυμπία Παναγιώτα Ρέα Σοφία Τερέζα Φωτεινή Χριστίνα".split(),
    ("greek", "m"): "Αλέξης Βασίλης Γρηγόρης Δημήτρης Εμμανουήλ Ζήσης Ηλίας Θάνος Ιάσονας Κώστας Λεωνίδας Μάριος Ξενοφών Ορέστης Πέτρος Ραφαήλ Στέλιος Τάσος Φίλιππος Χάρης".split(),
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Жанна Зоя Инна Клара Лидия Марта Нина Ольга Полина Раиса Софья Тамара Ульяна Фаина Юлия".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Илья Кирилл Лев Марк Никита Олег Павел Роман Степан Тимур Федор Юрий Яков".split(),
}
FAMILY = {
    "latin": "Abel Bauer Conrad Dreyer Engel Fabre Garnier Holm Ivers Jansen Keller Lorenz Marten Nolte Ortega Palmer Quist Renner Sander Thorne Ulmer Valdez Weber Yates Zeller".split(),
    "greek": "Αγγέλου Βλάχος Γεωργίου Δήμου Ευαγγέλου Ζέρβας Θεοδώρου Ιωάννου Κόκκινος Λάμπρου Μακρής Νικολάου Ξανθός Οικονόμου Παππάς Ράλλης Σταύρου Τσάκος Φωτίου Χρήστου".split(),
    "cyrillic": "Беляев Волков Громов Дроздов Ершов Жуков Зимин Ильин Котов Лосев Морозов Носков Орлов Попов Рыбин Сомов Титов Уваров Фомин Яшин".split(),
}
_SYLLABLES = {"latin": "ba de fi go lu ma ne ri so tu va zen kal mir dor lin".split(), "greek": "βα δε φι γο λου μα νε ρι σο του".split(), "cyrillic": "ба де фи го лу ма не ри со ту ва зен кал мир дор лин".split()}

#: What further names end in, by script and role, after two syllables or more.
_ENDINGS = {
    "latin": {"f": "la na ra ssa tta line", "m": "las mir no rd rik to", "family": "ck ler ller mann nsen rt sky tti"}, "greek": {"f": "να ρα λη τη", "m": "νης ρος λος τας", "family": "δης κης λου πουλος"},
    "cyrillic": {"f": "на ра ла ся", "m": "мир слав н р", "family": "нко ров лин вский"},
}


def luhn(digits: str) -> bool:
    total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


@lru_cache(maxsize=50_000)
def script_of(word: str) -> str:
    """The script of a word's first letter, by its Unicode name: latin, cyrillic, greek, arabic, ..."""
    return next((unicodedata.name(c, "latin").split()[0].lower() for c in word if c.isalpha()), "latin")


@lru_cache(maxsize=10_000)
def letters_like(char: str) -> str:
    """The letters of the same category in the block of 128 code points around a letter: those of its script."""
    start = ord(char) & ~127
    return "".join(c for c in map(chr, range(start, start + 128)) if unicodedata.category(c) == unicodedata.category(char) and c.lower().upper() == c.upper() and len(c.lower()) == 1) or char


_ALL = re.compile("(?s:.*)")
#: What splits a card or IBAN match into groups, and where the search goes on in a match of which nothing passes.
SPLITS = {"card": (re.compile(r"[ -]"), re.compile(r"[ -](?=\d{4})")), "iban": (re.compile(" "), re.compile(" "))}


def passes(kind: str, raw: str) -> bool:
    """Whether a card number or IBAN has a fitting length and checksum."""
    if kind == "card":
        digits = "".join(c for c in raw if c.isdecimal())
        return 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1
    value = raw.replace(" ", "")
    return 15 <= len(value) <= 34 and iban_ok(value)


def checked(kind: str, pattern: re.Pattern[str], text: str, taken: bytearray) -> Iterator[re.Match[str]]:
    """Matches that pass, or in their place the longest start of theirs that does and ends at a separator."""
    split, again = SPLITS[kind]
    at = 0
    while m := pattern.search(text, at):
        start, end = m.span()
        for stop in (end, *(s.start() for s in reversed([*split.finditer(text, start, end)]))):
            if not any(taken[start:stop]) and passes(kind, text[start:stop]):
                yield _ALL.match(text, start, stop)
                at = stop
                break
        else:
            later = again.search(text, start, end)
            at = later.end() if later else end


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """Entities of a text as (start, end, type, normalised value), sorted and without overlap; the earlier pattern wins."""
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))

    def name(start: int, stop: int, gender: str, given: str = "") -> bool:
        """Takes the capitalised words from ``start`` on as a person's given and family names, the known given name first."""
        words = []
        for w in re.finditer(_NAME, text[start:stop]):
            if not w[0][0].isupper() and w[0][0].lower() != w[0][0].upper() or any(taken[start + w.start() : start + w.end()]):
                break
            if w[0] in TITLES:
                break
            words.append((start + w.start(), start + w.end(), w[0]))
        if not words:
            return False
        if given and words[0][2] != given or words[0][2] in MALE_NAMES | FEMALE_NAMES:
            gender = "m" if words[0][2] in MALE_NAMES else "f"
        for k, (a, b, w) in enumerate(words):
            role = "family" if k == len(words) - 1 and not (len(words) == 1 and given) else f"given-{gender}"
            found.append((a, b, f"{role}-{script_of(w)}", w.casefold()))
            taken[a:b] = b"\1" * (b - a)
        return True

    for kind, pattern in PATTERNS:
        for m in checked(kind, pattern, text, taken) if kind in SPLITS else pattern.finditer(text):
            start, end = m.span(m.lastindex) if kind in ("secret", "person") and m.lastindex else m.span()
            if kind == "person":
                titled = m[1] in TITLES
                if not titled and not text[start].isupper():
                    continue
                gender = "m" if m[1] in MALE_TITLES or m[1] in MALE_NAMES else "f" if m[1] in FEMALE_TITLES or m[1] in FEMALE_NAMES else "x"
                at = max((b for a, b, k, _ in found if a >= start and b <= end), default=end) if name(start if titled else m.start(1), end, gender, "" if titled else m[1]) else None
                while at is not None and (more := _NEXT.match(text, at)) and more[1][0].isupper() and all(w[:1].isupper() for w in more[1].split()[:2]):
                    at = max(b for a, b, k, _ in found if a >= more.start(1)) if name(more.start(1), more.end(1), "x") else None
                continue
            raw = text[start:end]
            if any(taken[start:end]):
                continue
            if not raw.isascii():  # digits of another script
                raw = "".join(str(int(c)) if c.isdecimal() else c for c in raw)
            digits = re.sub(r"\D", "", raw)
            if kind == "secret" and not any(c.isalnum() for c in raw):  # a line to fill in
                continue
            if kind == "email":
                value = raw.lower()
            elif kind == "card":
                value = digits
            elif kind == "iban":
                value = raw.replace(" ", "").upper()
            elif kind == "ip":
                if any(int(x) > 255 for x in raw.split(".")) or _VERSION.search(text, max(0, start - 16), start):
                    continue
                value = raw
            elif kind == "ip6":
                try:
                    value = ipaddress.IPv6Address(raw).exploded
                except ValueError:
                    continue
                if "::" in raw and (raw.count(":") < 3 or not digits):  # a scope of a programming language
                    continue
            elif kind == "phone":
                if not (9 if raw[0] == "0" else 7) <= len(digits) <= 15:
                    continue
                value = digits
            else:
                value = raw
            found.append((start, end, kind, value))
            taken[start:end] = b"\1" * (end - start)
    return sorted(found)


class Stream:
    """Numbers drawn by HMAC-SHA256 from a key and a message, without end."""

    def __init__(self, key: bytes, *message: str):
        self.key, self.message, self.block, self.pool = key, "\x1f".join(message).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hmac.new(self.key, self.message + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        x, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return x % n

    def like(self, text: str, digits: str = "0123456789") -> str:
        """Each letter or digit replaced by one of its class and script, the rest kept."""
        hexed = re.fullmatch(r"[0-9a-f]+", text) and re.search(r"[a-f]", text) and re.search(r"\d", text)
        if hexed:
            return "".join("0123456789abcdef"[self.below(16)] for _ in text)
        out = []
        for c in text:
            if c.isascii() and c.isdigit():
                out.append(digits[self.below(len(digits))])
            elif c.isascii() and c.isalpha():
                x = "abcdefghijklmnopqrstuvwxyz"[self.below(26)]
                out.append(x.upper() if c.isupper() else x)
            elif c.isalpha():
                pool = letters_like(c)
                out.append(pool[self.below(len(pool))])
            else:
                out.append(c)
        return "".join(out)


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The normalised surrogate of a normalised value; another for each attempt."""
    s = Stream(key, kind, value, str(attempt))
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        same = Stream(key, "domain", domain)  # mail of one domain stays together
        return f"{s.like(local) + (s.like('a' * attempt) if attempt > 4 else '')}@{'.'.join([*(same.like(x) for x in labels[:-1]), labels[-1]])}"
    if kind == "card":
        body = value[0] + s.like(value[1:-1])
        return next(body + d for d in "0123456789" if luhn(body + d))
    if kind == "iban":
        body = s.like(value[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{value[:2]}00")) % 97
        return f"{value[:2]}{check:02d}{body}"
    if kind == "ip":
        ranges = {1: (1, 9), 2: (10, 90), 3: (100, 155)}
        return ".".join(str(low + s.below(n)) for low, n in (ranges[len(x)] if attempt < 20 else (1, 254) for x in value.split(".")))
    if kind == "ip6":
        return ":".join(f"{s.below(1 << 16):04x}" for _ in range(8))
    if kind == "phone":
        head = max(0, len(value) - 10)
        return value[:head] + s.like(value[head : head + 1], "23456789") + s.like(value[head + 1 :])
    if kind.startswith(("given", "family")):
        script = kind.rpartition("-")[2]
        if script not in FAMILY:
            return s.like(value) + s.like(value[-1] * (attempt // 8))
        gender = kind.split("-")[1]
        pool = FAMILY[script] if kind.startswith("family") else GIVEN[script, gender] if gender != "x" else GIVEN[script, "f"] + GIVEN[script, "m"]
        if attempt == 0:
            return pool[s.below(len(pool))].casefold()
        ends = _ENDINGS[script]["family" if kind.startswith("family") else gender if gender != "x" else "fm"[s.below(2)]].split()
        return "".join(_SYLLABLES[script][s.below(len(_SYLLABLES[script]))] for _ in range(2 + attempt // 4)) + ends[s.below(len(ends))]
    drawn = s.like(value)
    if kind == "secret" and attempt >= 8:  # little to draw from, as in ---------1: marks are drawn as well
        drawn = "".join("abcdefghijklmnopqrstuvwxyz"[s.below(26)] if not c.isalnum() else c for c in drawn) + s.like("a" * (attempt // 16))
    return drawn


def _in_script(old: str, new: str) -> str:
    """A digit in the script of the one it replaces; anything else as it is."""
    return new if old.isascii() or not new.isdecimal() else chr(ord(old) - int(old) + int(new))


def fit(kind: str, value: str, raw: str) -> str:
    """A normalised surrogate in the format of the entity as it stands in the text."""
    if kind in ("card", "phone", "iban"):
        fill = iter(value.lower() if kind == "iban" and raw.islower() else value)
        return "".join(_in_script(c, next(fill, "")) if c.isalnum() else c for c in raw)
    if kind == "ssn":
        return "".join(map(_in_script, raw, value))
    if kind == "email":
        return value.upper() if raw.isupper() else value
    if kind == "ip6":
        return ":".join(f"{int(x, 16):x}" for x in value.split(":"))
    if kind.startswith(("given", "family")):
        return value.upper() if raw.isupper() and len(raw) > 1 else re.sub(r"σ\b", "ς", value.title())
    return value


def assign(entities: DataFrame, key: bytes, max_rounds: int = 40) -> DataFrame:
    """(kind, value, attempt) of the distinct (kind, value) rows whose first draw is not theirs to keep.

    Surrogates by these attempts, and by attempt 0 for all others, are distinct and are no entities themselves. A value that finds
    none in ``max_rounds`` draws, for want of room in its format, keeps the last draw: it is replaced, if not by a distinct one.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "attempt")), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("value"), pa.array([surrogate(key, *r) for r in rows], type=pa.string())], names=["kind", "value", "surrogate"])

    values = cut(entities.select("kind", "value").distinct())
    done: list[DataFrame] = []
    later: list[DataFrame] = []
    left = values
    for attempt in range(max_rounds):
        drawn = cut(left.withColumn("attempt", F.lit(attempt)).mapInArrow(draw, "kind string, value string, surrogate string"))
        taken = reduce(DataFrame.union, [values.select("kind", F.col("value").alias("surrogate")), *(d.select("kind", "surrogate") for d in done)])
        first = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        won = cut(first.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "value", "surrogate"))
        done.append(won)
        if attempt:
            later.append(won.select("kind", "value", F.lit(attempt).alias("attempt")))
        left = cut(drawn.join(won, ["kind", "value"], "left_anti").select("kind", "value"))
        if left.isEmpty():
            break
    later.append(left.select("kind", "value", F.lit(max_rounds - 1).alias("attempt")))
    return reduce(DataFrame.union, later)


def replace_entities(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """``docs`` with surrogates in place of the entities of the text column.

    With ``report``, also ``n_entities`` and ``entity_types`` (sorted, distinct). Rows, their other columns and texts without
    entities stay as they are; null and empty texts too. Rows that repeat an id, or have a null one, are each served; where patterns
    overlap, the earlier one of PATTERNS wins. An empty table gives an empty result.
    """
    docs = docs.drop(*({"n_entities", "entity_types"} & set(docs.columns))) if report else docs
    small_batches(docs.sparkSession)
    hinted = F.coalesce(F.col(text_col).rlike(HINT), F.lit(False))
    near = docs.where(hinted)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = [(i, k, v) for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True) for k, v in {(k, v) for _, _, k, v in detect(t)}]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], type=t) for j, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["id", "kind", "value"])

    row_key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))  # rows that share it share their entities
    seen = cut(near.select(row_key.alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, "id long, kind string, value string"))
    later = cut(assign(seen, key))
    own = (
        join_sized(seen, later, ["kind", "value"], later.count()).groupBy("id")
        .agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "kind", "value"), "attempt"))).alias("_folio_map"))
        .withColumnRenamed("id", "_folio_id")
    )
    kept = docs.columns
    at = kept.index(text_col)
    schema = with_fields(docs, n_entities="long", entity_types="array<string>") if report else docs.schema

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = lru_cache(maxsize=100_000)(lambda kind, value, attempt: surrogate(key, kind, value, attempt))
        for batch in chunks(batches, text_col):
            texts, counts, types = [], [], []
            for text, pairs in zip(batch.column(at).to_pylist(), batch.column("_folio_map").to_pylist(), strict=True):
                known = dict(pairs or ())
                out, done, kinds = [], 0, []
                for start, end, kind, value in detect(text):
                    out += [text[done:start], fit(kind, drawn(kind, value, known.get(f"{kind}:{value}", 0)), text[start:end])]
                    done = end
                    kinds.append(kind)
                texts.append("".join([*out, text[done:]]))
                counts.append(len(kinds))
                types.append(sorted(set(kinds)))
            columns = [batch.column(k) for k in range(len(kept))]
            columns[at] = pa.array(texts, type=pa.string())
            told = [pa.array(counts, type=pa.int64()), pa.array(types, type=pa.list_(pa.string()))] if report else []
            yield pa.RecordBatch.from_arrays([*columns, *told], names=[*kept, *("n_entities", "entity_types")[: len(told)]])

    joined = near.join(own, row_key == F.col("_folio_id"), "left").select(*own_columns(docs), "_folio_map")
    none = {"n_entities": F.lit(0).cast("long"), "entity_types": F.array().cast("array<string>")} if report else {}
    return joined.mapInArrow(swap, schema).union(docs.where(~hinted).withColumns(none))
