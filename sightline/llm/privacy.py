"""Personal data replaced by keyed surrogates.

Entities are found by pattern. Every distinct entity gets one surrogate, made from a keyed hash, of the same type and
format: e-mail for e-mail, digits for digits in the same grouping, a card number with a valid check digit for one, a name
of the same gender and script. So the same entity reads the same everywhere. Surrogates that two entities would share, or
that are themselves an entity of the corpus, are made anew a few times; formats that have no room for that are exchanged by a
keyed permutation. So different entities stay different, and it always ends.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import col, keyed, written

KEY = b"replace me by a secret of your own"

# Patterns of entities, titles by gender, given names by gender, syllables by script.
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "secret": r"\b(?:AKIA[0-9A-Z]{16}|(?:sk|ghp|pk|xoxb)[-_][A-Za-z0-9_-]{16,}|[0-9a-f]{32,128}|[0-9A-F]{32,128})\b",
    "card": r"(?<![\d.+-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{15,16})(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w.])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+(?!1\b)\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})"
             r"(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?![\w-]|\.\d)",
    "name": r"\b(?:{titles})\.? +(?:{capital}(?: +(?={capital})|\b)){{1,3}}|\b(?:{given}) +{capital}",
}
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Señora Sra Doña Lady Signora Госпожа", "m": "Mr Herr Monsieur Señor Sr Don Sir Signor Господин",
          "": "Dr Prof Professor"}
GIVEN = {"f": ("Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Maria Emma Sophie Julia Laura "
               "Marie Claire Camille Lucia Carmen Elena Sofia Isabel Ursula Monika Petra Sabine Анна Мария Елена Ольга"),
         "m": ("James Robert John Michael David William Richard Joseph Thomas Charles Peter Paul Hans Klaus Jürgen Stefan "
               "Pierre Jean Louis Luc Carlos José Juan Pedro Miguel Antonio Иван Сергей Алексей Дмитрий")}
CAPITAL = r"[A-ZÀ-ÖØ-ÞА-Я][a-zß-öø-ÿа-я'’-]+"
SYLLABLES = {"latin": "ba da fe ga ha jo ka li ma ne no pa ri ro sa se ta ti vo we", "cyrillic": "ба ва га да жо ка ли ма не но па ри ро са се та ти во зе фи"}
ENDS = {("f", "latin"): "na la ra", ("m", "latin"): "n r s", ("f", "cyrillic"): "на ла ра", ("m", "cyrillic"): "н р с",
        ("", "latin"): "mer ton ler", ("", "cyrillic"): "мов нин лев"}
SPECIAL = ("10", "127", "172", "192")  # first numbers of private and special address ranges
TURNS, ROUNDS = 8, 8
GENDER_OF_TITLE = {t: g for g, words in TITLES.items() for t in words.split()}
GENDER_OF_GIVEN = {n: g for g, words in GIVEN.items() for n in words.split()}
_FOUND = re.compile("|".join(f"(?P<{k}>" + (p.format(titles="|".join(GENDER_OF_TITLE), capital=CAPITAL, given="|".join(GENDER_OF_GIVEN))
                                            if k == "name" else p) + ")" for k, p in PATTERNS.items()))
# what every match of a pattern holds, so a text without any of these holds no entity; searched one by one, which is quicker
_DIGITS, _NAMES = r"\d(?:\d|\.\d)", [*GENDER_OF_TITLE, *GENDER_OF_GIVEN]
NEEDS = {"email": "@", "iban": _DIGITS, "secret": r"(?=[0-9a-fA-Fsgpx])\b(?:AKIA|(?:sk|ghp|pk|xoxb)[-_]|[0-9a-fA-F]{32})", "card": _DIGITS,
         "ip": _DIGITS, "ssn": _DIGITS, "phone": _DIGITS,
         "name": "(?=[" + "".join(sorted({n[0] for n in _NAMES})) + r"])\b(?:" + "|".join(_NAMES) + r")\b"}
_MAY = [re.compile(x).search for x in dict.fromkeys(NEEDS[k] for k in PATTERNS)]


def may_hold(text: str) -> bool:
    return any(search(text) for search in _MAY)


# whole capitalised words, and the parts of double ones
_CAPITALISED = re.compile(r"\b[A-ZÀ-ÖØ-ÞА-Я][^\W\d_]*(?:['’-][^\W\d_]+)*(?!\w)")
_PART = re.compile(r"[^'’-]+")
_POSSESSIVE = re.compile(r"['’]s?$|-+$")


def mentions(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical entity) of every mention; of a name, every word is an entity of its own, so that a
    surname alone agrees with the full name. A name word found anywhere in the text is found wherever it stands alone, too."""
    out, names = [], {}
    if not text or not may_hold(text):
        return out
    for m in _FOUND.finditer(text):
        kind, value = m.lastgroup, m.group()
        if kind == "name":
            words = [(w.start() + m.start(), w.end() + m.start(), w.group()) for w in re.finditer(r"[^\s.]+", value)]
            gender = ""
            if words[0][2] in GENDER_OF_TITLE:
                gender = GENDER_OF_TITLE[words[0][2]]
                words = words[1:]
            for k, (a, b, w) in enumerate(words):
                w = _POSSESSIVE.sub("", w)
                given = w in GENDER_OF_GIVEN or (k == 0 and len(words) > 1)
                out.append((a, a + len(w), f"given {GENDER_OF_GIVEN.get(w, gender)}" if given else "surname", w))
                if w not in GENDER_OF_TITLE:
                    names.setdefault(w, out[-1][2])
        else:
            out.append((m.start(), m.end(), kind, canonical(kind, value)))
    if names:
        taken = [(a, b) for a, b, _, _ in out]  # in the order of the text
        for m in _CAPITALISED.finditer(text):
            at, word = m.start(), m.group()
            bare = next(([(at, w)] for w in (word, _POSSESSIVE.sub("", word)) if w in names), None)
            for a, w in bare or [(at + x.start(), x.group()) for x in _PART.finditer(word) if x.group() in names]:
                k = bisect.bisect_right(taken, (a, len(text)))
                if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or a + len(w) <= taken[k][0]):
                    out.append((a, a + len(w), names[w], w))
        out.sort()
    return out


def canonical(kind: str, value: str) -> str:
    if kind == "email":
        return value.lower()
    if kind in ("card", "phone", "ssn"):
        return ("+" if value[0] == "+" else "") + re.sub(r"\D", "", value)
    return value.replace(" ", "") if kind == "iban" else value


class _Stream:
    """Numbers from a keyed hash of (kind, entity, attempt)."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.seed, self.block, self.left = key, "\x1f".join(map(str, parts)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n

    def alike(self, text: str) -> str:
        """Every letter and digit replaced by one of its class."""
        out = []
        hexadecimal = re.fullmatch("[0-9a-fA-F]{32,}", text)
        for c in text:
            if hexadecimal:
                out.append(("0123456789ABCDEF" if text.upper() == text else "0123456789abcdef")[self.below(16)])
            elif c.isdigit():
                out.append(str(self.below(10)))
            elif c.isascii() and c.isalpha():
                out.append(chr((65 if c.isupper() else 97) + self.below(26)))
            else:
                out.append(c)
        return "".join(out)


def _luhn(digits: str) -> int:
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def surrogate(kind: str, entity: str, attempt: int = 0, key: bytes = KEY) -> str:
    """A canonical entity of the same kind and format."""
    s = _Stream(key, kind, entity, attempt)
    if kind == "email":
        local, _, domain = entity.partition("@")
        host, _, top = domain.rpartition(".")
        return s.alike(local) + "@" + _Stream(key, "domain", host).alike(host) + "." + top
    if kind == "phone":
        keep = 0 if entity[0] != "+" else 2 if entity[1] in "17" else 3  # the country code
        return entity[:keep] + "".join(str(s.below(8) + 2) if i == 0 else str(s.below(10)) for i in range(len(entity) - keep))
    if kind == "card":
        body = entity[0] + s.alike(entity[1:-1])
        check = _luhn(body)
        return body + str(check if _luhn(entity[:-1]) == int(entity[-1]) else (check + 1 + s.below(9)) % 10)
    if kind == "ip":
        octets = entity.split(".")
        low, high = {1: (1, 9), 2: (10, 99), 3: (100, 255)}, octets
        made = [low[len(o)][0] + s.below(low[len(o)][1] - low[len(o)][0] + 1) for o in high]
        if octets[0] in SPECIAL:  # these stay what they are
            made[0] = int(octets[0])
        return ".".join(map(str, made))
    if kind == "secret":
        head = re.match(r"AKIA|(?:sk|ghp|pk|xoxb)[-_]|", entity).group()
        return head + s.alike(entity[len(head):])
    if kind == "iban":
        return entity[:2] + s.alike(entity[2:])
    if kind.startswith(("given", "surname")):
        script = "cyrillic" if re.search("[а-яА-Я]", entity) else "latin"
        parts, ends = SYLLABLES[script].split(), ENDS[kind[6:] if kind.startswith("given") else "", script].split()
        word = "".join(parts[s.below(len(parts))] for _ in range(2 + s.below(2) + attempt // 3)) + ends[s.below(len(ends))]
        return word.capitalize()
    return s.alike(entity)


# formats whose surrogates run out

class _Format:
    """The values that an entity's format has room for, as numbers: each varying part has an alphabet, the rest is kept."""

    def __init__(self, kind: str, entity: str):
        hexadecimal = "" if kind != "secret" or not re.fullmatch("[0-9a-f]{32,}|[0-9A-F]{32,}", entity) else \
            "0123456789abcdef" if entity == entity.lower() else "0123456789ABCDEF"
        self.kind, self.tail = kind, 0
        if kind == "ip":
            octets = entity.split(".")
            self.parts = [_octets(o, i == 0) for i, o in enumerate(octets)]
            self.values, self.glue = octets, "."
        else:
            keep = 0
            if kind == "phone":
                keep = 0 if entity[0] != "+" else 2 if entity[1] in "17" else 3  # the country code
            elif kind == "secret" and not hexadecimal:
                keep = len(re.match(r"AKIA|(?:sk|ghp|pk|xoxb)[-_]|", entity).group())
            elif kind == "iban":
                keep = 2
            elif kind == "card":  # the last digit follows from the others
                keep, self.tail = 1, (int(entity[-1]) - _luhn(entity[:-1])) % 10
            end = len(entity) - (kind == "card") if kind != "email" else entity.rindex(".")
            self.parts = [_alphabet(c, hexadecimal) if keep <= i < end else [c] for i, c in enumerate(entity)]
            if kind == "card":
                self.parts.pop()
            self.values, self.glue = entity[:len(self.parts)], ""
        self.size = 1
        for p in self.parts:
            self.size *= len(p)

    def label(self) -> str:
        """The same for all entities whose surrogates could meet."""
        shape = ".".join(str(len(v)) for v in self.values) if self.kind == "ip" else "".join(
            f"{len(p)}{p[-1]}" if len(p) > 1 else "=" + p[0] for p in self.parts)
        return f"{self.kind} {shape} {self.tail}"

    def number(self) -> int:
        total = 0
        for p, v in zip(self.parts, self.values):
            total = total * len(p) + p.index(v)
        return total

    def value(self, number: int) -> str:
        out = []
        for p in reversed(self.parts):
            number, at = divmod(number, len(p))
            out.append(p[at])
        made = self.glue.join(reversed(out))
        return made + str((_luhn(made) + self.tail) % 10) if self.kind == "card" else made


def _alphabet(c: str, hexadecimal: str) -> list[str]:
    if hexadecimal:
        return list(hexadecimal)
    if c.isascii() and c.isdigit():
        return list("0123456789")
    if c.isascii() and c.isalpha():
        return [chr((65 if c.isupper() else 97) + i) for i in range(26)]
    return [c]


def _octets(octet: str, first: bool) -> list[str]:
    """Octets of the same length; private and special ranges stay what they are."""
    if first and octet in SPECIAL:
        return [octet]
    low, high = {1: (0, 9), 2: (10, 99), 3: (100, 255)}[len(octet)]
    found = [str(i) for i in range(low, high + 1) if not (first and str(i) in SPECIAL)]
    return found if octet in found else [octet]


def _walk(key: bytes, label: str, x: int, size: int, rounds: range) -> int:
    """A keyed permutation of 0 to size - 1 by a Feistel network, its inverse with the rounds turned round."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    while True:
        left, right = x >> half, x & (1 << half) - 1
        for r in rounds:
            if rounds.step > 0:
                left, right = right, left ^ _round(key, label, r, right, half)
            else:
                left, right = right ^ _round(key, label, r, left, half), left
        x = left << half | right
        if x < size:  # else on along the cycle
            return x


def _round(key: bytes, label: str, r: int, x: int, bits: int) -> int:
    seed = f"{label}\x1f{r}\x1f{x}".encode()
    wide = b"".join(hmac.new(key, seed + bytes([i]), hashlib.sha256).digest() for i in range(-(-bits // 256)))
    return int.from_bytes(wide, "big") & (1 << bits) - 1


def exchanged(kind: str, entity: str, key: bytes = KEY) -> str:
    """The surrogate of an entity in a format without room: in a secret order of all values of the format, the next one. So
    no two entities share one, none keeps its own, and every value may be used."""
    form = _Format(kind, entity)
    if form.size < 2:
        return entity
    label = form.label() + f" {form.parts[0][0] if kind == 'ip' and len(form.parts[0]) == 1 else ''}"
    place = _walk(key, label, form.number(), form.size, range(ROUNDS))
    return form.value(_walk(key, label, (place + 1) % form.size, form.size, range(ROUNDS - 1, -1, -1)))


def formatted(kind: str, mention: str, made: str) -> str:
    """The surrogate in the mention's own format: its grouping, its case."""
    if kind in ("card", "phone", "ssn", "iban"):
        chars = iter(made.removeprefix("+"))
        return "".join(next(chars) if c.isalnum() else c for c in mention)
    if kind == "email" and mention.isupper():
        return made.upper()
    return made


def surrogates(entities: DataFrame, key: bytes = KEY, turns: int = TURNS) -> DataFrame:
    """kind, entity, made: one surrogate for every distinct entity, none shared.

    Surrogates are tried ``turns`` times, and none that is an entity itself is taken. Names grow with every third try, so
    there always is another one. Formats of which some entity is left without a surrogate are short of values, such as the
    addresses x@y.co of a very large corpus: their entities are all exchanged by one permutation of the format's values, which
    needs no tries and has no two alike. Only there a surrogate may be another entity of the corpus.
    """
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(made=[surrogate(k, e, int(a), key) for k, e, a in zip(b["kind"], b["entity"], b["attempt"])])

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(label=[_Format(k, e).label() for k, e in zip(b["kind"], b["entity"])])

    def exchange(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(made=[exchanged(k, e, key) for k, e in zip(b["kind"], b["entity"])])

    kind = F.substring_index("kind", " ", 1)  # given names of all genders are one space
    is_name = kind.isin("given", "surname")
    real = written(entities.select("kind", "entity").distinct())
    done, turn, attempt = None, real.withColumn("attempt", F.lit(0)), 0
    while turn is not None:
        made = turn.mapInPandas(make, "kind string, entity string, attempt int, made string")
        made = made.withColumn("fresh", F.lit(True))
        table = written(made if done is None else made.unionByName(done.withColumn("fresh", F.lit(False))))
        # those already settled come first, then the smallest entity
        first = table.groupBy(kind.alias("space"), F.col("made")).agg(F.min(F.struct("fresh", "kind", "entity")).alias("first"))
        taken = real.select(kind.alias("space"), F.col("entity").alias("made")).distinct()
        judged = (table.withColumn("space", kind).join(first, ["space", "made"])
                  .join(taken.withColumn("real", F.lit(True)), ["space", "made"], "left")
                  .withColumn("ok", F.col("real").isNull() & (F.struct("fresh", "kind", "entity") == F.col("first"))))
        judged = written(judged.select("kind", "entity", "attempt", "made", "ok"))
        done, again = judged.where("ok").drop("ok"), judged.where("not ok")
        attempt += 1
        if attempt == turns and again.where(~is_name).limit(1).count():
            short = again.where(~is_name).select("kind", "entity").mapInPandas(labelled, "kind string, entity string, label string")
            full = real.where(~is_name).mapInPandas(labelled, "kind string, entity string, label string").join(
                short.select("label").distinct(), "label", "left_semi").select("kind", "entity")
            swapped = written(full.mapInPandas(exchange, "kind string, entity string, made string"))
            done = written(done.join(swapped, ["kind", "entity"], "left_anti").unionByName(
                swapped.withColumn("attempt", F.lit(turns))))
            again = again.where(is_name)
        turn = again.select("kind", "entity", F.lit(attempt).alias("attempt")) if again.limit(1).count() else None
    return done.select("kind", "entity", "made")


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """id, text, n_entities: the text with surrogates in place of personal data, and the number of mentions.

    One row per row of ``docs``. Null texts stay null, empty ones empty. Repeated rows get the same text. Texts without a
    mention pass straight through; only the others are shuffled. An empty table gives no rows.
    """
    own, keys = keyed(docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")), "id", "text")
    types = ", ".join(f"{k} {own.schema[k].dataType.simpleString()}" for k in keys)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*ks, *m) for *ks, text in zip(*[b[k] for k in keys], b["text"]) for m in mentions(text)]
            yield pd.DataFrame(rows, columns=[*keys, "start", "stop", "kind", "entity"])

    found = written(own.select(*keys, "text").mapInPandas(find, f"{types}, start int, stop int, kind string, entity string").distinct())
    made = surrogates(found, key)
    # an entity on a third of all rows is a skewed key of this join only, which adaptive planning splits
    lists = found.join(made, ["kind", "entity"]).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("start", "stop", "kind", "made"))).alias("found"))

    @F.pandas_udf("boolean")
    def has_any(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([bool(mentions(t)) for t in texts], dtype=bool)

    @F.pandas_udf("string")
    def replaced(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            out = []
            for text, places in zip(texts, lists):
                parts, at = [], 0
                for p in places:
                    parts += [text[at:p["start"]], formatted(p["kind"], text[p["start"]:p["stop"]], p["made"])]
                    at = p["stop"]
                out.append("".join(parts) + text[at:])
            yield pd.Series(out, dtype=object)

    flagged = own.withColumn("any", has_any("text"))
    plain = flagged.where("not any").select("id", "text", F.lit(0).cast("long").alias("n_entities"))
    changed = own.where(has_any("text")).join(lists, keys).select(
        "id", replaced("text", "found").alias("text"), F.size("found").cast("long").alias("n_entities"))
    return plain.unionByName(changed)
