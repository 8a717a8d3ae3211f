"""Personal data replaced by keyed, type-consistent surrogates."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.skew import broadcast_if_small
from shelfcast.session import store_table

KEY = "surrogates-1"
MAX_ATTEMPTS = 30

# Titles and the gender they tell, and given names and family names by script.
TITLES = {
    "mr": "m", "herr": "m", "monsieur": "m", "señor": "m", "sr": "m", "sir": "m", "господин": "m",
    "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "madame": "f", "mme": "f", "señora": "f", "sra": "f",
    "madam": "f", "госпожа": "f", "dr": "n", "prof": "n",
}
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Noel Oscar Paul".split(),
    ("latin", "f"): "Anna Bella Clara Diana Emma Flora Greta Helen Irene Julia Karin Laura Marie Nora Olga Paula".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Максим Олег Павел Роман".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Полина".split(),
}
SYLLABLES = {
    "latin": "ba ben cor dal den fer gar hal kor lan mar nel or pel ris sal tan vel wes zin".split(),
    "cyrillic": "ба бен вол гор дан жар зим кал лан мар нел ор пет рин сав тар фед хар чер шан".split(),
}
FEMALE_ENDING = {"latin": "", "cyrillic": "а"}
ENDING = {"latin": "", "cyrillic": "ов"}

# What is detected, in order of precedence. Decorations of up to six signs may stand inside phone numbers.
PATTERNS = (
    ("secret_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("email", r"[\w.%+\-]+@[\w\-]+(?:\.[\w\-]+)*\.[^\W\d_]{2,}"),
    ("secret", r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_\-]{16,}|xox[abprs]-[A-Za-z0-9\-]{10,}"
               r"|eyJ[\w\-]{8,}\.[\w\-]{8,}\.[\w\-]{4,})"),
    ("secret", r"(?<=[=:]\")[^\"\s]{12,}(?=\")|(?<=[=:] \")[^\"\s]{12,}(?=\")"),
    ("secret", r"\b(?=[0-9A-Fa-f]*\d)(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{24,}\b"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ip", r"\b(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}\b(?!\.\d)"),
    ("card", r"\b\d(?:[ \-]?\d){12,18}\b"),
    ("phone", r"\+\d{1,3}\W{0,6}\(?\d{2,4}\)?(?:\W{1,6}\d{3,4}){2}\b|\(\d{3}\)\W{0,6}\d{3}\W{1,6}\d{4}\b"
              r"|\b\d{3}[\-.]\d{3}[\-.]\d{4}\b"
              # Other groupings: any of an international number, and national ones that begin with a nought.
              r"|\+[1-9](?:[ \-./()]{0,3}\d){7,14}(?!\d)|\b0\d(?:[ .\-]\d{2}){4}\b"
              r"|\b0\d{2,4}[ /\-]{1,3}\d{5,8}\b|\b0\d{2,4} \d{3,4} \d{3,4}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("number", r"\b\d{9,12}\b"),
    ("name", r"\b(?:(?i:" + "|".join(sorted(TITLES, key=len, reverse=True)) + r"))\b\.? "
             r"[^\W\d_a-zà-ÿа-я][^\W\d_]+(?: [^\W\d_a-zà-ÿа-я][^\W\d_]+)?"),
)
DETECT = re.compile("|".join(f"(?P<k{i}>{p})" for i, (_, p) in enumerate(PATTERNS)), re.DOTALL)
WORTH = re.compile(r"\d|@|-----BEGIN|\b(?:" + "|".join(TITLES) + r")\b", re.IGNORECASE)


def detect(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, type and surface of each entity, left to right, none overlapping."""
    if WORTH.search(text):
        for found in DETECT.finditer(text):
            yield found.start(), found.end(), PATTERNS[int(found.lastgroup[1:])][0], found[0]


def canonical(kind: str, surface: str) -> str:
    """The form in which mentions of one entity are equal."""
    if kind in ("phone", "card", "ssn", "number"):
        return "".join(c for c in surface if c.isdigit())
    if kind == "iban":
        return surface.replace(" ", "")
    if kind == "name":
        title, name = _title(surface)
        return f"{TITLES[title.strip(' .').lower()]} {name.casefold()}"
    return surface.lower() if kind == "email" else surface


def _title(surface: str) -> tuple[str, str]:
    cut = re.match(r"\S+ ", surface).end()
    return surface[:cut], surface[cut:]


def _stream(key: str, kind: str, value: str, attempt: int) -> Callable[[int], int]:
    """Keyed numbers below a bound, the same for the same entity wherever it occurs."""
    state = {"n": 0, "pool": 0, "left": 0}

    def draw(bound: int) -> int:
        if state["left"] < 24:
            block = hashlib.blake2b(f"{kind}\0{value}\0{attempt}\0{state['n']}".encode(),
                                    key=key.encode()[:64]).digest()
            state.update(n=state["n"] + 1, pool=int.from_bytes(block, "big"), left=512)
        state["pool"], out = divmod(state["pool"], bound)
        state["left"] -= bound.bit_length()
        return out
    return draw


def _like(value: str, draw: Callable[[int], int], hexadecimal: bool = False) -> str:
    """Each letter or digit replaced by one of its kind: case, script and signs stay."""
    out = []
    for c in value:
        if c.isdigit():
            out.append(str(draw(10)))
        elif hexadecimal and c in "abcdefABCDEF":
            out.append("abcdef"[draw(6)] if c.islower() else "ABCDEF"[draw(6)])
        elif "a" <= c <= "z" or "A" <= c <= "Z":
            out.append(chr(ord("a" if c.islower() else "A") + draw(26)))
        elif "а" <= c.lower() <= "я":
            letter = chr(ord("а") + draw(32))
            out.append(letter if c.islower() else letter.upper())
        elif c.isalpha():
            letter = chr(ord("a") + draw(26))
            out.append(letter.upper() if c.isupper() else letter)
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def surrogate(kind: str, value: str, key: str, attempt: int) -> str:
    """Canonical surrogate of a canonical value; the attempt changes it after a collision.

    Each attempt makes names a syllable and local parts of e-mails a letter longer, so their number has no bound.
    """
    draw = _stream(key, kind, value, attempt)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        # Domains keep their coreference: the same domain always becomes the same one.
        of_domain = _stream(key, "domain", domain, 0)
        labels[:-1] = [_like(x, of_domain) for x in labels[:-1]]
        return f"{_like(local + 'a' * attempt, draw)}@{'.'.join(labels)}"
    if kind == "ip":
        return ".".join(str(1 + draw(254)) for _ in range(4))
    if kind == "card":
        body = value[0] + _like(value[1:-1], draw)
        check = (10 - _luhn(body + "0")) % 10
        return body + str(check if _luhn(value) == 0 else (check + 1 + draw(9)) % 10)
    if kind == "phone":
        keep = len(value) - 10 if len(value) > 10 else 0  # the country code
        return value[:keep] + _like(value[keep:], draw)
    if kind == "iban":
        return value[:2] + _like(value[2:], draw)
    if kind == "name":
        gender, _, name = value.partition(" ")
        script = "cyrillic" if re.search("[а-яё]", name) else "latin"
        chosen = gender if gender in "mf" else "mf"[draw(2)]
        parts = name.split(" ")
        family = "".join(SYLLABLES[script][draw(20)] for _ in range(3 + attempt)) + ENDING[script]
        family = (family + (FEMALE_ENDING[script] if chosen == "f" else "")).capitalize()
        names = GIVEN[(script, chosen)]
        return f"{gender} {names[draw(len(names))]} {family}" if len(parts) > 1 else f"{gender} {family}"
    if kind == "secret_block":
        head, rest = value[:value.index("-----", 5) + 5], value[value.index("-----", 5) + 5:]
        cut = rest.rindex("-----END")
        return head + _like(rest[:cut], draw) + rest[cut:]
    return _like(value, draw, hexadecimal=bool(re.fullmatch("[0-9A-Fa-f]+", value)))


def render(kind: str, surface: str, new: str) -> str:
    """A canonical surrogate in the format of the mention: its signs, spaces, case and title."""
    if kind in ("phone", "card", "ssn", "number", "iban"):
        letters = iter(new)
        return "".join(next(letters) if c.isalnum() else c for c in surface)
    if kind == "email" and surface.isupper():
        return new.upper()
    if kind == "name":
        title, name = _title(surface)
        plain = new.partition(" ")[2]
        return title + (plain.upper() if name.isupper() and len(name) > 2 else plain)
    return new


def _entities(key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [])
            for text, digest in zip(batch.column("text").to_pylist(), batch.column("digest").to_pylist(), strict=True):
                for kind, value in {(k, canonical(k, s)) for _, _, k, s in detect(text or "")}:
                    for column, x in zip(columns, (digest, kind, value, surrogate(kind, value, key, 0)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64() if i == 0 else pa.string()) for i, c in enumerate(columns)],
                names=["digest", "kind", "value", "surrogate"])
    return run


def _again(key: str, attempt: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist(), strict=True)
            new = [surrogate(k, v, key, attempt) for k, v in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("kind"), batch.column("value"), pa.array(new, pa.string()),
                 pa.array([attempt] * len(new), pa.int32())], names=["kind", "value", "surrogate", "attempt"])
    return run


def _plain(value: str) -> Column:
    """What is compared with real values: of a name the lower case, whatever the gender."""
    return F.when(F.col("kind") == "name", F.regexp_replace(F.lower(value), "^[mfn] ", "")).otherwise(F.col(value))


def resolve(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``kind, value, surrogate, attempt`` with distinct surrogates, none of them a real value.

    ``entities`` are distinct (kind, value, surrogate). Of values with one surrogate the smallest keeps it;
    the others, and those whose surrogate is a real value, try again; only they are looked at anew.
    """
    real = entities.select("kind", _plain("value").alias("plain")).distinct().withColumn("real", F.lit(True))
    settled = store_table(entities.select("kind", "value", "surrogate", F.lit(0).alias("attempt")), "surrogates-0")
    schema = "kind string, value string, surrogate string, attempt int"
    for attempt in range(1, MAX_ATTEMPTS + 1):
        keeper = settled.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "value")).alias("first"))
        taken = keeper.withColumn("plain", _plain("surrogate")).join(real, ["kind", "plain"], "left").drop("plain")
        judged = settled.join(taken, ["kind", "surrogate"]).withColumn(
            "bad", F.coalesce("real", F.lit(False)) | (F.col("first.value") != F.col("value")))
        losers = judged.filter("bad").select("kind", "value")
        if not losers.take(1):
            return settled
        again = losers.mapInArrow(_again(key, attempt), schema)
        settled = store_table(
            judged.filter("not bad").select("kind", "value", "surrogate", "attempt").unionByName(again),
            f"surrogates-{attempt}")
    raise RuntimeError(f"surrogates still collide after {MAX_ATTEMPTS} attempts")


def replace_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", secret: str = KEY) -> DataFrame:
    """``key, text, n_entities, kinds`` of each document, with personal data replaced.

    A surrogate is a keyed function of type and value: mentions of one entity agree in all documents, the
    type, script, gender (told by a title) and format stay. All distinct entities are checked: no two share
    a surrogate, and no surrogate is itself a detected value. The few that collide get another attempt, and
    reach the documents that mention them by a join on key and text hash; the texts are not shuffled as long
    as that list is small. A null text stays null. Keys may be null or repeat; other columns are ignored.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn(
        "digest", F.xxhash64("key", "text"))
    found = store_table(source.select("text", "digest").mapInArrow(
        _entities(secret), "digest long, kind string, value string, surrogate string").distinct(), "entities")
    settled = resolve(found.select("kind", "value", "surrogate").distinct(), secret)
    changed = settled.filter("attempt > 0").select("kind", "value", "attempt")
    extra = store_table(
        found.join(changed, ["kind", "value"]).groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct(
            F.concat_ws("\0", "kind", "value"), "attempt"))).alias("attempts")), "attempts")
    joined = source.join(broadcast_if_small(extra, extra.count()), "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, kinds = [], [], []
            for value, attempts in zip(batch.column("text").to_pylist(), batch.column("attempts").to_pylist(),
                                       strict=True):
                retries = dict(attempts or ())
                out, at, seen = [], 0, []
                for start, end, kind, surface in detect(value or ""):
                    plain = canonical(kind, surface)
                    new = surrogate(kind, plain, secret, retries.get(f"{kind}\0{plain}", 0))
                    out += [value[at:start], render(kind, surface, new)]
                    at = end
                    seen.append(kind)
                texts.append(value if value is None else "".join(out) + value[at:])
                counts.append(len(seen))
                kinds.append(sorted(set(seen)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()),
                 pa.array(kinds, pa.list_(pa.string()))], names=["key", "text", "n_entities", "kinds"])

    kind = dict(source.dtypes)["key"]
    replaced = joined.select("key", "text", "attempts").mapInArrow(
        run, f"key {kind}, text string, n_entities long, kinds array<string>")
    return replaced.select(F.col("key").alias(key), F.col("text").alias(text), "n_entities", "kinds")
