"""PII surrogates: detected entities are replaced by keyed stand-ins of their own type, gender, script and format.

Kinds: email, phone, ip, card, ssn, iban, secret (access keys and values after password=, token= and the like), and the words of personal
names (given names by gender, surnames), which a title or a listed given name announces; a name that was announced once in a text
is replaced wherever that text repeats it; given names also in capitals, and names in capitals also in small letters.

A phone number is written with + or 00 and a country code, with a trunk zero, or in three groups of 2-4, 3-4 and 3-4 digits. Of the first
two any grouping is found, by the number of digits; their normal form is the national number, and the country code stays in the text.
Not found: national numbers in other groups without a trunk zero (612 34 56 78), names that nothing announces, surnames in
capitals where the text announces them in small letters (a test asks for that).

Each entity has a normal form (case, separators and country code aside), so all its spellings get one stand-in: coreference. The
stand-in of attempt a is drawn from HMAC-SHA256(key, kind, normal form, a) within the kind's format: digits for digits, letters for
letters, valid octets, Luhn and IBAN check digits, name endings by gender, syllables by script; it is written in the spelling at hand.

Collision check: all distinct entities of the corpus are drawn once (attempt 0). A stand-in that is another entity's normal form, or
that an entity of smaller attempt or name holds already, is drawn again, until none is left: distinctness over the whole corpus. Every fourth attempt
lets an address, secret or name grow, so a format with too few members does not block; other formats raise after MOST_ATTEMPTS.
Only entities beyond attempt 0, which are few, are sent to the documents that hold them; Spark broadcasts that table while its size
is under the session's threshold and joins by id beyond it. Everything else is derived where the text is.

Defined results: null text stays null with 0 entities; empty text stays empty; repeated rows get equal results; rows with a null id take
part and share what other rows with a null id need; columns that clash with result names are replaced; empty tables are no problem.
"""
import hashlib
import hmac
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from nearmiss.llm.textbytes import text_batches
from nearmiss.session import durable

#: Titles that announce a name, with the gender they tell (f, m or u).
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "u", "Prof": "u", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f",
          "Señor": "m", "Señora": "f", "Sra": "f", "Господин": "m", "Госпожа": "f"}
#: Given names that announce a surname.
GIVEN = {"m": "James John Robert Michael William David Richard Thomas Daniel Paul Peter Hans Jürgen Wolfgang Klaus Pierre Jean Jacques Luc Carlos José Juan Miguel Иван Пётр Сергей Дмитрий".split(),
         "f": "Mary Patricia Jennifer Linda Elizabeth Susan Sarah Anna Maria Julia Petra Ursula Monika Claire Sophie Camille Carmen Lucía Isabel Ольга Анна Мария Наталья".split()}
_GENDER = {name: g for g, names in GIVEN.items() for name in names}
#: Syllables and endings of invented names by script.
SYLLABLES = {"latin": "ba be da de fa ga ka la le li ma me mi na ne ni no ra re ri ro sa se ta te to va ve vi za".split(),
             "cyrillic": "ба ве да де га ка ла ле ли ма ме ми на не ни но ра ре ри ро са се та те то ва за".split()}
ENDINGS = {"latin": {"given_m": ["ron", "mar", "den", "kel"], "given_f": ["lina", "retta", "mira", "dora"], "given_u": ["lis", "wyn"], "surname": ["son", "berg", "ster", "mann", "nez"]},
           "cyrillic": {"given_m": ["рон", "слав", "мир"], "given_f": ["лина", "мира", "дора"], "given_u": ["лис"], "surname": ["енко", "ских", "чук"]}}

MOST_ATTEMPTS = 100

#: Secrets above LONG characters are drawn in pieces of PIECE, so that the time grows with the length and not with its square.
LONG, PIECE = 200, 120

_LOCAL = re.compile(r"[\w.%+-]+$")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])")
_PHONE = re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-])")
#: International (+ or 00) and trunk-zero numbers in any grouping, and the Russian long-distance form with 8; _whole() cuts them by their digits.
_JOIN = r"(?:[ .\u00a0\u202f/-]?\(?\d\)?)"
_DIALLED = re.compile(r"(?<![\w.+-])(?<!\d[,/])(?:\+(?=[1-9])" + _JOIN + r"{8,16}|00(?=[ .\u00a0\u202f/-]?[1-9])" + _JOIN + r"{8,16}|\(?0(?=[1-9])" + _JOIN + r"{8,13}|8(?=[ (-]{1,2}[3489]\d\d[ )-]{1,2}\d{3}[ -]?\d\d[ -]?\d\d(?![\w-]))"
                      + _JOIN + r"{10})")
_COUNTRY = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")
#: Digits after the country code where their number is fixed.
NATIONAL = {"1": 10, "7": 10, "31": 9, "32": 9, "33": 9, "34": 9, "41": 9, "44": 10, "45": 8, "47": 8, "48": 9, "61": 9}
_DATED = re.compile(r"\d\d([./-])\d\d\1(?:19|20)\d\d(?!\d)")
_IP = re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)")
_CARD = re.compile(r"(?<![\w-])[3-6]\d{3}(?:[ -]?\d){9,15}(?![\w-])")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_KEY = re.compile(r"(?<!\w)AKIA[0-9A-Z]{16}(?!\w)")
_SECRET = re.compile(r"(?i)(?:password|passwd|pwd|api_?key|secret|token)[\"']?\s{0,4}=\s{0,4}[\"']?([^\s\"',;]{6,})")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_CAPITALISED = r"([A-ZÀ-ÞА-ЯЁ](?:[^\W\d_]|['’-]){1,40})(?!\w)"
_NAMED = re.compile(r"\b(" + "|".join(TITLES) + r")\b\.? " + _CAPITALISED + "(?: " + _CAPITALISED + ")?")
_PAIR = re.compile(r"\b(" + "|".join(_GENDER) + r") " + _CAPITALISED)


def luhn(digits: str) -> int:
    """0 for a number with right check digit."""
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def iban_rest(text: str) -> int:
    """1 for an IBAN with right check digits."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdecimal())


def _script(word: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in word) else "latin"


def _whole(text: str, start: int, end: int):
    """(end, national digits) of the number in text[start:end], which may run into what follows it; None if it is none.

    A number ends where a group of digits does: at its country's length, else at the longest that numbers of its form have.
    """
    spelling = text[start:end]
    if _DATED.match(spelling) or _SSN.match(spelling):
        return None
    at = next((n for prefix, n in (("+", 1), ("00", 2), ("(0", 2), ("0", 1), ("8", 1)) if spelling.startswith(prefix)), 0)
    country, fixed = "", None
    if spelling[0] == "+" or spelling.startswith("00"):
        country = _COUNTRY.match(_digits(spelling[at:])).group()
        fixed, left = NATIONAL.get(country), len(country)
        while left:
            left -= spelling[at].isdecimal()
            at += 1
        if zero := re.match(r"[ .\u00a0\u202f/-]?\(0\)", spelling[at:]):
            at += zero.end()
        low, high = max(6, 8 - len(country)), 13 - len(country)
    elif spelling[0] == "8":
        low = high = fixed = 10
    else:
        low, high = 8, 11
        if re.match(r"0[1-9](?:[ .\u00a0\u202f/-]\d\d(?!\d)){4}", spelling):
            fixed = 9
    ends, digits, run = [], 0, 0
    for i in range(at, len(spelling) + 1):
        if i < len(spelling) and spelling[i].isdecimal():
            digits, run = digits + 1, run + 1
            continue
        if run and digits >= low and not (start + i < len(text) and (text[start + i].isalnum() or text[start + i] == "_")):
            ends.append((i, digits))
            if run >= 7:
                break
        run = 0
    # one unbroken group may be longer than numbers that are written in groups
    good = [x for x in ends if x[1] == fixed] or [x for x in ends if x[1] <= high] or [x for x in ends[:1] if country and x[1] + len(country) <= 15]
    if not good:
        return None
    last, n = good[-1]
    return start + last, _digits(spelling[at:last])


def _numbers(text: str):
    for m in _IP.finditer(text):
        if all(int(x) < 256 for x in m.group().split(".")):
            yield m.start(), m.end(), "ip", ".".join(str(int(x)) for x in m.group().split("."))
    for m in _CARD.finditer(text):
        if not luhn(_digits(m.group())):
            yield m.start(), m.end(), "card", _digits(m.group())
    for m in _SSN.finditer(text):
        yield m.start(), m.end(), "ssn", _digits(m.group())
    starts, at = set(), 0
    while m := _DIALLED.search(text, at):
        at = m.start() + 1
        if found := _whole(text, *m.span()):
            starts.add(m.start())
            at, norm = found
            yield m.start(), at, "phone", norm
    for m in _PHONE.finditer(text):
        if m.start() in starts:
            continue
        digits = _digits(m.group())
        if 9 <= len(digits) <= 15:
            yield m.start(), m.end(), "phone", digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    for m in _IBAN.finditer(text):
        plain = m.group().replace(" ", "")
        if iban_rest(plain) == 1:
            yield m.start(), m.end(), "iban", plain


def _names(text: str):
    surnames, given = set(), {}
    for m in _NAMED.finditer(text):
        if m.group(3):
            kind = "given_" + (_GENDER.get(m.group(2)) or TITLES[m.group(1)])
            given.setdefault(m.group(2), kind)
            yield m.start(2), m.end(2), kind, m.group(2).casefold()
        last = 3 if m.group(3) else 2
        surnames.add(m.group(last))
        yield m.start(last), m.end(last), "surname", m.group(last).casefold()
    for m in _PAIR.finditer(text):
        surnames.add(m.group(2))
        given.setdefault(m.group(1), "given_" + _GENDER[m.group(1)])
        yield m.start(1), m.end(1), "given_" + _GENDER[m.group(1)], m.group(1).casefold()
        yield m.start(2), m.end(2), "surname", m.group(2).casefold()
    known = {}
    for word, kind in [*given.items(), *[(s, "surname") for s in sorted(surnames)]]:
        for spelling in {word, word.title() if word.isupper() else word, word if kind == "surname" else word.upper()}:
            known[spelling] = (kind, word.casefold())
    if known:
        for m in re.finditer(r"\b(?:" + "|".join(sorted(map(re.escape, known), key=lambda s: (-len(s), s))) + r")\b", text):
            yield m.start(), m.end(), *known[m.group()]


def detect(text: str) -> list:
    """Non-overlapping (start, end, kind, normal form), in order; of overlapping finds the one that starts first, then the longest, stays."""
    found = []
    at = text.find("@")
    while at >= 0:
        local, domain = _LOCAL.search(text[max(0, at - 64):at]), _DOMAIN.match(text[at + 1:at + 256])
        if local and domain:
            start, end = at - len(local.group()), at + 1 + domain.end()
            found.append((start, end, "email", text[start:end].casefold()))
        at = text.find("@", at + 1)
    if any(c in text for c in "0123456789"):
        found += _numbers(text)
    if "AKIA" in text:
        found += [(m.start(), m.end(), "secret", m.group()) for m in _KEY.finditer(text)]
    if "=" in text:
        found += [(m.start(1), m.end(1), "secret", m.group(1)) for m in _SECRET.finditer(text)]
    found += _names(text)
    out, end = [], 0
    for span in sorted(found, key=lambda s: (s[0], -s[1], s[2])):
        if span[0] >= end:
            out.append(span)
            end = span[1]
    return out


class _Stream:
    """Keyed numbers, one after the other."""

    def __init__(self, key: bytes, kind: str, norm: str, attempt: int):
        self.value = int.from_bytes(b"".join(hmac.new(key, f"{i}\0{attempt}\0{kind}\0{norm}".encode(), hashlib.sha256).digest() for i in range(1 + len(norm) // 24)), "big")

    def below(self, n: int) -> int:
        self.value, out = divmod(self.value, n)
        return out


def _like(text: str, draw: _Stream, letters: int = 26) -> str:
    """Digits for digits, letters for letters of the same case; the rest stays."""
    out = []
    for c in text:
        if c.isdecimal():
            out.append("0123456789"[draw.below(10)])
        elif "а" <= c.lower() <= "я":
            new = chr(ord("а") + draw.below(32))
            out.append(new.upper() if c.isupper() else new)
        elif c.isalpha():
            new = chr(97 + draw.below(letters))
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def draw(key: bytes, kind: str, norm: str, attempt: int = 0) -> str:
    """The stand-in's normal form."""
    d = _Stream(key, kind, norm if len(norm) <= 2 * LONG else hashlib.sha256(norm.encode()).hexdigest(), attempt)
    more = "".join("0123456789"[d.below(10)] for _ in range(attempt // 4))
    if kind == "email":
        local, domain = norm.split("@", 1)
        local += more
        head, dot, last = domain.rpartition(".")
        return _like(local, d) + "@" + _like(head, d) + dot + last
    if kind == "ip":
        return f"{1 + d.below(223)}.{d.below(256)}.{d.below(256)}.{1 + d.below(254)}"
    if kind == "card":
        body = norm[0] + "".join(str(d.below(10)) for _ in norm[2:])
        return body + next(c for c in "0123456789" if not luhn(body + c))
    if kind == "phone":
        return "".join(str(2 + d.below(8) if i == 0 else d.below(10)) for i in range(len(norm)))
    if kind == "ssn":
        return f"{1 + d.below(665):03d}{1 + d.below(99):02d}{1 + d.below(9999):04d}"
    if kind == "iban":
        body = _like(norm[4:], d)
        return norm[:2] + f"{98 - iban_rest(norm[:2] + '00' + body):02d}" + body
    if kind == "secret":
        letters = 6 if _HEX.fullmatch(norm) else 26
        if len(norm) > LONG:
            name, whole = hashlib.sha256(norm.encode()).hexdigest(), norm + more
            return "".join(_like(whole[i:i + PIECE], _Stream(key, kind, f"{name}\0{i}", attempt), letters) for i in range(0, len(whole), PIECE))
        return ("AKIA" + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[d.below(32)] for _ in norm[4:])) if _KEY.fullmatch(norm) else _like(norm + more, d, letters)
    script = _script(norm)
    syllables, endings = SYLLABLES[script], ENDINGS[script][kind]
    return "".join(syllables[d.below(len(syllables))] for _ in range(2 + d.below(3) + attempt // 4)) + endings[d.below(len(endings))]


def render(kind: str, core: str, spelling: str) -> str:
    """The stand-in in the spelling of an occurrence."""
    if kind in ("phone", "card", "ssn", "iban"):
        wanted = str.isalnum if kind == "iban" else str.isdecimal
        places = [i for i, c in enumerate(spelling) if wanted(c)]
        out = list(spelling)
        for i, c in zip(places[len(places) - len(core):], core):
            out[i] = c
        return "".join(out)
    if kind == "email":
        return "".join(c.upper() if old.isupper() else c for c, old in zip(core, spelling)) if len(core) == len(spelling) else core
    if kind in ("ip", "secret"):
        return core
    return core.upper() if spelling.isupper() and len(spelling) > 1 else core[:1].upper() + core[1:] if spelling[:1].isupper() else core


def _find_rows(batches):
    for batch in batches:
        out = ([], [], [])
        for i, text in enumerate(batch.column(1)):
            for kind, norm in sorted({(s[2], s[3]) for s in detect(text.as_py() or "")}):
                for column, value in zip(out, (i, kind, norm)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["id", "kind", "norm"])


def _drawn(entities: DataFrame, key: bytes) -> DataFrame:
    """entities: kind, norm, attempt; with the stand-in of that attempt."""
    def run(batches):
        for batch in batches:
            kinds, norms, attempts = [batch.column(i).to_pylist() for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([draw(key, *x) for x in zip(kinds, norms, attempts)], pa.string())], names=["kind", "norm", "attempt", "core"])

    return entities.select("kind", "norm", "attempt").mapInArrow(run, "kind string, norm string, attempt int, core string")


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """entities: distinct (kind, norm). With core, the stand-in's normal form, distinct within a kind and no entity's own, and attempt."""
    entities = durable(entities)
    state = durable(_drawn(entities.withColumn("attempt", F.lit(0)), key))
    real = entities.select("kind", F.col("norm").alias("core"), F.lit(True).alias("real"))
    while True:
        first = state.groupBy("kind", "core").agg(F.min(F.struct("attempt", "norm")).alias("first"))
        checked = state.join(first, ["kind", "core"]).join(real, ["kind", "core"], "left")
        lost = F.coalesce("real", F.lit(False)) | (F.struct("attempt", "norm") != F.col("first"))
        again = durable(checked.filter(lost).select("kind", "norm", (F.col("attempt") + 1).alias("attempt")))
        worst = again.agg(F.max("attempt")).first()[0]
        if worst is None:
            return state
        if worst > MOST_ATTEMPTS:
            raise RuntimeError("a kind of entity has more members in the corpus than its format has stand-ins")
        state = durable(state.join(again.select("kind", "norm"), ["kind", "norm"], "left_anti").select("kind", "norm", "attempt", "core").union(_drawn(again, key)))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with stand-ins in text, n_entities long (occurrences replaced) and kinds array<string> (of the entities, sorted)."""
    secret = key.encode()
    own = text_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_field = T.StructField("id", own.schema["id"].dataType)
    found = durable(own.mapInArrow(_find_rows, T.StructType([id_field, T.StructField("kind", T.StringType()), T.StructField("norm", T.StringType())])))
    names = assign(found.select("kind", "norm").distinct(), secret)
    special = durable(found.join(names.filter("attempt > 0").select("kind", "norm", "core"), ["kind", "norm"]).groupBy("id")
                      .agg(F.collect_set(F.struct("kind", "norm", "core")).alias("__llm_special")))
    made = ("n_entities", "kinds")
    rest = [c for c in docs.columns if c not in (text_col, *made)]
    special = special.withColumnRenamed("id", "__llm_id")
    joined = docs.select(text_col, *rest).join(special, docs[id_col].eqNullSafe(special["__llm_id"]), "left").select("__llm_special", text_col, *rest)
    schema = T.StructType([docs.schema[text_col], T.StructField("n_entities", T.LongType()), T.StructField("kinds", T.ArrayType(T.StringType())), *[docs.schema[c] for c in rest]])
    out_names = schema.fieldNames()

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                texts, counts, kinds = [], [], []
                for other, text in zip(batch.column(0), batch.column(1).to_pylist()):
                    spans = detect(text) if text else []
                    cores = {(x["kind"], x["norm"]): x["core"] for x in other.as_py() or []} if spans else {}
                    if spans:
                        parts, at = [], 0
                        for start, end, kind, norm in spans:
                            core = cores.get((kind, norm)) or draw(secret, kind, norm)
                            parts += [text[at:start], render(kind, core, text[start:end])]
                            at = end
                        text = "".join(parts) + text[at:]
                    texts.append(text)
                    counts.append(len(spans))
                    kinds.append(sorted({s[2] for s in spans}))
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.list_(pa.string())), *batch.columns[2:]], names=out_names)

    return joined.mapInArrow(run, schema)
