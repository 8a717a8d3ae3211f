"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine."""

from __future__ import annotations

import itertools
import sys
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.session import store_table

# Kernel: subsequences of three characters within six, a factor per character they span.
ORDER, SPAN, DECAY = 3, 6, 0.6
# Matches below this are none; units longer than this are compared in overlapping parts.
LEAST_MATCH, UNIT_CHARS = 0.35, 32
LANDMARKS, ALIKE = 128, 0.65
# Sentences of a clean document that the machine is fitted on: those that most resemble toxic ones.
HARD_SENTENCES = 3
# Levels of a word's margin at which a document's words are counted.
LEVELS = (-0.75, -0.25, 0.25)
# Most labelled documents that the model is fitted on.
TRAIN_DOCS = 20_000
# Words, and words that match anything, that a task remembers; beyond, it begins anew.
KNOWN_WORDS, KNOWN_MATCHES = 200_000, 32_768
# Units compared with the landmarks at once, and those of one length among them.
UNITS, ROWS = 8192, 1024

_LETTERS = 64
_START, _END, _OTHER = 1, 2, 3


def _codes(unit: str) -> list[int]:
    """Characters as small numbers: letters a-z, folds of other letters, one number for the rest, with ends marked."""
    out = [_START]
    for c in unit:
        if "a" <= c <= "z":
            out.append(ord(c) - 93)  # 4 to 29
        elif c.isalpha():
            out.append(30 + ord(c) % (_LETTERS - 30))
        else:
            out.append(_OTHER)
    out.append(_END)
    return out


def _code_table() -> np.ndarray:
    """The number of each character, filled as characters come; 0 where not known yet."""
    return np.zeros(sys.maxunicode + 1, dtype=np.uint8)


def _codes_of(units: list[str], length: int, table: np.ndarray) -> np.ndarray:
    """The numbers of units of one length, one row each, by a table of those of characters."""
    points = np.frombuffer("".join(units).encode("utf-32-le"), dtype="<u4").reshape(len(units), length)
    codes = table[points]
    if length and not codes.all():
        for point in np.unique(points[codes == 0]):
            table[point] = _codes(chr(point))[1]
        codes = table[points]
    out = np.empty((len(units), length + 2), dtype=np.int32)
    out[:, 0], out[:, 1:-1], out[:, -1] = _START, codes, _END
    return out


def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    places = [p for p in itertools.combinations(range(length), ORDER) if p[-1] - p[0] < SPAN]
    index = np.array(places, dtype=np.int64).reshape(-1, ORDER)
    return index, (DECAY ** (index[:, -1] - index[:, 0] + 1 - ORDER)).astype(np.float32)


class StringKernel:
    """Normalised gap-weighted subsequence kernel between units and a fixed list of landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.shapes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        # For each subsequence of a landmark its row; a row lists the landmarks that have it, with their shares.
        self.row_of = np.full(_LETTERS ** ORDER, -1, dtype=np.int32)
        rows: list[dict[int, float]] = []
        for number, unit in enumerate(landmarks):
            codes, weights = self._subsequences(np.array([_codes(unit)], dtype=np.int32))
            norm = _norms(codes, weights)
            for code, weight in zip(codes[0], weights, strict=True):
                if self.row_of[code] < 0:
                    self.row_of[code] = len(rows)
                    rows.append({})
                row = rows[self.row_of[code]]
                row[number] = row.get(number, 0.0) + weight / norm[0]
        self.starts = np.cumsum([0, *map(len, rows)])
        self.owners = np.array([n for row in rows for n in row], dtype=np.int64)
        self.shares = np.array([v for row in rows for v in row.values()], dtype=np.float64)
        # The largest share of a landmark in each subsequence; rounded up, as it bounds what a unit can reach.
        self.most = np.zeros(_LETTERS ** ORDER, dtype=np.float32)
        for code in np.flatnonzero(self.row_of >= 0):
            row = self.row_of[code]
            self.most[code] = self.shares[self.starts[row]:self.starts[row + 1]].max() * (1 + 1e-6)
        self.table = _code_table()

    def _subsequences(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all subsequences of units of one length, and their weights."""
        length = units.shape[1]
        if length not in self.shapes:
            self.shapes[length] = _triples(length)
        index, weights = self.shapes[length]
        codes = units[:, index[:, 0]]
        for j in range(1, ORDER):
            codes = codes * _LETTERS + units[:, index[:, j]]
        return codes, weights

    def __call__(self, units: list[str], least: float = 0.0) -> np.ndarray:
        """One row per unit; the best part of a long unit counts. Rows without a value from ``least`` on are 0."""
        out = np.zeros((len(units), len(self.landmarks)), dtype=np.float32)
        by_length: dict[int, list[int]] = {}
        parts: list[tuple[int, list[int]]] = []
        for i, unit in enumerate(units):
            if len(unit) + 2 <= UNIT_CHARS:
                by_length.setdefault(len(unit), []).append(i)
            else:
                codes, step = _codes(unit), UNIT_CHARS // 2
                for at in range(0, len(codes) - step, step):
                    parts.append((i, codes[max(0, min(at, len(codes) - UNIT_CHARS)):][:UNIT_CHARS]))
        for length, rows in by_length.items():
            if length + 2 < ORDER:
                continue
            for at in range(0, len(rows), ROWS):
                some = rows[at:at + ROWS]
                near, similar = self._similar(_codes_of([units[i] for i in some], length, self.table), least)
                out[np.array(some)[near]] = similar
        for at in range(0, len(parts), ROWS):
            some = parts[at:at + ROWS]
            near, similar = self._similar(np.array([c for _, c in some], dtype=np.int32), least)
            np.maximum.at(out, [some[f][0] for f in near], similar)
        return out

    def _similar(self, units: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Of units of one length, given as numbers, those that may reach ``least`` with a landmark, and their values."""
        codes, weights = self._subsequences(units)
        # A norm is least when all subsequences differ; units that are too far even so need none.
        needed = least * np.sqrt((weights ** 2).sum()) * (1 - 1e-5)
        # Most words are too far even if one landmark had the largest share of each of their subsequences.
        bound = self.most[codes] @ weights
        some = np.flatnonzero((bound > 0) & (bound >= needed * (1 - 1e-5)))
        codes = codes[some]
        hits = self.row_of[codes]
        unit, place = np.nonzero(hits >= 0)
        first = self.starts[hits[unit, place]]
        lengths = self.starts[hits[unit, place] + 1] - first
        ends = np.cumsum(lengths)
        entry = np.repeat(first - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
        cell = np.repeat(unit * len(self.landmarks), lengths) + self.owners[entry]
        raw = np.bincount(cell, self.shares[entry] * np.repeat(weights[place], lengths),
                          minlength=len(some) * len(self.landmarks)).reshape(len(some), len(self.landmarks))
        most = raw.max(axis=1, initial=0)
        near = np.flatnonzero((most > 0) & (most >= needed))
        if not len(near):
            return near, np.empty((0, len(self.landmarks)), dtype=np.float32)
        return some[near], (raw[near] / _norms(codes[near], weights)[:, None]).astype(np.float32)


def _norms(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Square roots of the kernel of each row of subsequences with itself."""
    order = np.argsort(codes, axis=1, kind="stable")
    ordered = np.take_along_axis(codes, order, axis=1)
    first = np.ones(codes.shape, dtype=bool)
    first[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    sums = np.add.reduceat(weights[order].ravel(), np.flatnonzero(first.ravel()))
    owners = np.nonzero(first)[0]
    return np.sqrt(np.bincount(owners, weights=sums.astype(np.float64) ** 2, minlength=len(codes)))


def _unit(word: str) -> str:
    """A word in lower case without the signs around it."""
    if word.isascii() and word[:1].isalnum() and word[-1].isalnum():
        return word.lower()
    at, end = 0, len(word)
    while at < end and not word[at].isalnum():
        at += 1
    while end > at and not word[end - 1].isalnum():
        end -= 1
    return unicodedata.normalize("NFC", word[at:end].lower())


def sentences(text: str) -> Iterator[list[str]]:
    """Words of each sentence: sentences end with a line or with a word ending in a full stop and the like.

    Three or more single letters in a row also give the word they spell.
    """
    for line in text.split("\n"):
        found: list[str] = []
        for word in line.split():
            found.append(word)
            if word[-1] in ".!?":
                yield _spelled(found)
                found = []
        if found:
            yield _spelled(found)


def _spelled(words: list[str]) -> list[str]:
    if sum(map(len, words)) > 2 * len(words):
        single = [len(w) == 1 for w in words]
        if not any(single[i] and single[i + 1] and single[i + 2] for i in range(len(single) - 2)):
            return words
    out, letters = list(words), []
    for word in [*words, ""]:
        if len(_unit(word)) == 1:
            letters.append(_unit(word))
        else:
            if len(letters) > 2:
                out.append("".join(letters))
            letters = []
    return out


@dataclass
class Matches:
    """Words of some texts that match anything, as rows of a table of matches, and the sentences they stand in."""

    rows: np.ndarray  # one per match, in order
    sentence_starts: np.ndarray  # the first match of each sentence that has one
    sentence_text: np.ndarray  # and its text
    match_text: np.ndarray  # the text of each match
    sizes: np.ndarray  # words of each text


class SentenceFeatures:
    """For each sentence of a text, the best match of its words with each landmark."""

    def __init__(self, landmarks: list[str]):
        self.kernel = StringKernel(landmarks)
        self.forget()

    def forget(self) -> None:
        """Begin anew. Row 0 of the matches is that of words that match nothing."""
        self.place: dict[str, int] = {}
        # Of each known word: its row, its length, whether it ends a sentence.
        self.row, self.chars, self.ends = (np.empty(0, dtype=k) for k in (np.int32, np.int32, bool))
        self.matches = np.zeros((1, len(self.kernel.landmarks)), dtype=np.float32)
        self.count = 1

    def _learn(self, words: list[str]) -> None:
        own = list(map(_unit, words))
        units = list(dict.fromkeys(own))
        near = dict.fromkeys(units, 0)
        for at in range(0, len(units), UNITS):
            some = units[at:at + UNITS]
            similar = self.kernel(some, LEAST_MATCH)
            found = np.flatnonzero(similar.max(axis=1, initial=0) >= LEAST_MATCH)
            near.update(zip([some[i] for i in found], range(self.count, self.count + len(found)), strict=True))
            if self.count + len(found) > len(self.matches):
                grown = np.zeros((max(2 * len(self.matches), self.count + len(found)), self.matches.shape[1]), np.float32)
                grown[:self.count] = self.matches[:self.count]
                self.matches = grown
            values = similar[found]
            self.matches[self.count:self.count + len(found)] = np.where(values >= LEAST_MATCH, values, 0)
            self.count += len(found)
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.row = np.append(self.row, np.fromiter(map(near.__getitem__, own), np.int32, len(words)))
        self.chars = np.append(self.chars, np.fromiter(map(len, words), np.int32, len(words)))
        self.ends = np.append(self.ends, np.fromiter((w[-1] in ".!?" for w in words), bool, len(words)))

    def _places(self, words: list[str], keep: bool = False) -> np.ndarray:
        found = list(map(self.place.get, words))
        if None in found:
            new = {w for w, p in zip(words, found, strict=True) if p is None}
            if not keep and (len(self.place) + len(new) > KNOWN_WORDS or self.count > KNOWN_MATCHES):
                self.forget()
                new = set(words)
            self._learn(list(new))
            found = list(map(self.place.__getitem__, words))
        return np.array(found, dtype=np.int64)

    def find(self, texts: list[str]) -> Matches:
        """The matches of all texts; a sentence ends as ``sentences`` has it, with the words its letters spell."""
        words: list[str] = []
        line_ends, text_ends = [0], [0]
        for text in texts:
            for line in text.split("\n"):
                words += line.split()
                line_ends.append(len(words))
            text_ends.append(len(words))
        sizes = np.diff(text_ends)
        if not words:
            nothing = np.empty(0, dtype=np.int64)
            return Matches(nothing, nothing, nothing, nothing, sizes)
        places = self._places(words)
        last = self.ends[places]
        last[np.array(line_ends[1:], dtype=np.int64) - 1] = True
        stops = np.flatnonzero(last) + 1
        starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
        sentence = np.repeat(np.arange(len(stops)), stops - starts)
        text_of = np.searchsorted(np.array(text_ends[1:]), starts, side="right")
        # Sentences that may spell words: of few letters each, or with three single ones in a row.
        chars = self.chars[places]
        odd = np.add.reduceat(chars, starts) <= 2 * (stops - starts)
        single = (chars == 1) & np.append(chars[1:] == 1, False)  # and the next one
        in_row = np.flatnonzero(single[:-2] & single[1:-1] & (sentence[:-2] == sentence[2:]))
        odd[sentence[in_row]] = True
        extra, owners = [], []
        for s in np.flatnonzero(odd):
            own = words[starts[s]:stops[s]]
            spelled = _spelled(own)[len(own):]
            extra += spelled
            owners += [s] * len(spelled)
        rows = self.row[places]
        if extra:
            # They go behind the words of their sentences; what is known is kept meanwhile.
            behind = self._places(extra, keep=True)
            rows = np.concatenate([rows, self.row[behind]])
            sentence = np.concatenate([sentence, np.array(owners)])
            order = np.argsort(sentence, kind="stable")
            rows, sentence = rows[order], sentence[order]
            sizes = sizes + np.bincount(text_of[owners], minlength=len(texts))
        hit = np.flatnonzero(rows)
        rows, sentence = rows[hit], sentence[hit]
        firsts = np.flatnonzero(np.diff(sentence, prepend=-1))
        return Matches(rows, firsts, text_of[sentence[firsts]], text_of[sentence], sizes)

    def vectors(self, found: Matches) -> np.ndarray:
        """Of each sentence that has a match, the best with each landmark."""
        if not len(found.rows):
            return np.empty((0, self.matches.shape[1]), dtype=np.float32)
        return np.maximum.reduceat(self.matches[found.rows], found.sentence_starts, axis=0)

    def __call__(self, texts: list[str]) -> list[tuple[list[np.ndarray], list[np.ndarray], int]]:
        """Per text, the vectors of the sentences and of the words that match anything, and the count of words."""
        found = self.find(texts)
        vectors = self.vectors(found)
        sentence_at = np.searchsorted(found.sentence_text, np.arange(len(texts) + 1))
        match_at = np.searchsorted(found.match_text, np.arange(len(texts) + 1))
        return [(list(vectors[a:b]), list(self.matches[found.rows[c:d]]), int(size)) for (a, b), (c, d), size in zip(
            itertools.pairwise(sentence_at), itertools.pairwise(match_at), found.sizes, strict=True)]


def _in_parts(texts: list[str], chars: int = 1 << 20) -> Iterator[list[str]]:
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text)
        if held > chars:
            yield part
            part, held = [], 0
    if part:
        yield part


@dataclass
class ToxicityModel:
    """Landmarks, the weights on matches with them, and the calibration of document scores."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    calibration: np.ndarray  # of the document's features, then the intercept
    prior: float

    def document_features(self, features: SentenceFeatures, found: Matches) -> np.ndarray:
        """One row per text: its largest margin, the counts of its words above the levels, its words."""
        out = np.empty((len(found.sizes), len(LEVELS) + 2))
        margin = np.full(len(out), -np.inf)
        np.maximum.at(margin, found.sentence_text, features.vectors(found) @ self.weights + self.bias)
        out[:, 0] = np.clip(np.where(np.isinf(margin), self.bias, margin), -3, 3)
        different, place = np.unique(found.rows, return_inverse=True)
        words = (features.matches[different] @ self.weights + self.bias)[place]
        unmatched = np.bincount(found.match_text, minlength=len(out)) == 0
        for i, level in enumerate(LEVELS, start=1):
            above = np.bincount(found.match_text[words > level], minlength=len(out))
            out[:, i] = np.log1p(np.where(unmatched, self.bias > level, above))
        out[:, -1] = np.log1p(found.sizes)
        return out

    def scorer(self) -> Callable[[list[str]], Iterator[list[float]]]:
        features = SentenceFeatures(self.landmarks)

        def run(texts: list[str]) -> Iterator[list[float]]:
            for part in _in_parts(texts):
                yield from self.document_features(features, features.find(part)).tolist()
        return run

    def probability(self, features: list[float]) -> float:
        if not self.landmarks:
            return self.prior
        z = float(np.dot(self.calibration[:-1], features) + self.calibration[-1])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def is_held_out(key: Column) -> Column:
    """Whether the CRC-32 of the key as text is divisible by five; true for a null key."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _map(rows: DataFrame, schema: str, run: Callable[[pa.RecordBatch], Iterator[dict]]) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, batch.num_rows, 512):
                found = list(run(batch.slice(at, 512)))
                if found:
                    yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in found], schema=kinds)

    kinds = pa.schema([(p.split()[0], {"string": pa.string(), "double": pa.float64(), "int": pa.int32(),
                                       "array<double>": pa.list_(pa.float64())}[p.split()[1]])
                       for p in schema.split(", ")])
    return rows.mapInArrow(batches, schema)


def train_toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    most_docs: int = TRAIN_DOCS, n_landmarks: int = LANDMARKS,
) -> ToxicityModel:
    """Fit on labelled documents whose key is not held out, about ``most_docs`` of them by a hash of the key.

    1. Landmarks are the words whose presence in documents speaks most for the label, none much like an earlier one.
    2. Labelled sentences: of a clean document the three whose words speak most for the label, and an empty
       one; of a toxic document the one whose words do.
    3. A sentence's features are its best kernel value with each landmark, whitened by the landmarks' own
       kernel matrix (Nyström); a linear support vector machine is fitted on them.
    4. A logistic regression maps a document's largest sentence margin, the counts of words above some margins,
       and its length to a probability.

    Key, language, source and label are no features. Without both classes the model returns the prior.
    """
    marked = labels.select(F.col(key).alias("key"), F.col(label).alias("toxic")).filter(
        F.col("key").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col(key)))
    marked = marked.groupBy("key").agg(F.max("toxic").cast("double").alias("toxic"))
    share = min(1.0, most_docs / max(1, marked.count()))
    chosen = marked.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    # About ``most_docs`` rows of two numbers: a bounded broadcast.
    sample = store_table(
        docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "key").select("text", "toxic"), "toxicity-sample").repartition(
            int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0.0))).first()
    total, toxic = int(counts[0]), float(counts[1])
    prior = (toxic + 0.5) / (total + 1)
    empty = ToxicityModel([], np.zeros(0), 0.0, np.zeros(0), prior)
    if not 0 < toxic < total:
        return empty

    def units(batch: pa.RecordBatch) -> Iterator[dict]:
        for words, mark in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for unit in sorted({_unit(w) for s in sentences(words) for w in s} - {""}):
                yield {"unit": unit, "toxic": mark}

    seen = _map(sample, "unit string, toxic double", units).groupBy("unit").agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).filter("n >= 4")
    odds = F.log((F.col("t") + 0.5) / toxic) - F.log((F.col("n") - F.col("t") + 0.5) / (total - toxic))
    best = (seen.withColumn("odds", odds).filter("odds > 1")
            .orderBy((F.col("t") * F.col("odds")).desc(), "unit").limit(8 * n_landmarks).collect())
    if not best:
        return empty
    alike = StringKernel([r["unit"] for r in best])([r["unit"] for r in best])
    kept: list[int] = []
    for i in range(len(best)):
        if len(kept) < n_landmarks and (not kept or alike[i, kept].max() < ALIKE):
            kept.append(i)
    landmarks = [best[i]["unit"] for i in kept]
    evidence = np.array([best[i]["odds"] for i in kept], dtype=np.float32)
    own = StringKernel(landmarks)(landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T

    def labelled_sentences(batch: pa.RecordBatch) -> Iterator[dict]:
        features = SentenceFeatures(landmarks)
        marks = batch.column("toxic").to_pylist()
        for mark, (found, _, _) in zip(marks, features(batch.column("text").to_pylist()), strict=True):
            ranked = sorted(found, key=lambda z: -float((z * evidence).max()))
            found = ranked[:1] if mark > 0 else [*ranked[:HARD_SENTENCES], np.zeros(len(landmarks))]
            for z in found:
                yield {"label": mark, "features": (z @ whiten).tolist()}

    instances = store_table(
        _map(sample, "label double, features array<double>", labelled_sentences)
        .select("label", array_to_vector("features").alias("features")), "toxicity-sentences")
    sizes = {r["label"]: r["count"] for r in instances.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return empty
    balance = F.when(F.col("label") > 0, F.lit(sizes[0.0] / sizes[1.0]) ** 0.5).otherwise(F.lit(1.0))
    machine = LinearSVC(maxIter=30, regParam=1e-3, weightCol="weight", standardization=False).fit(
        instances.withColumn("weight", balance))
    model = ToxicityModel(landmarks, whiten @ machine.coefficients.toArray(), float(machine.intercept),
                          np.zeros(0), prior)

    def document_rows(batch: pa.RecordBatch) -> Iterator[dict]:
        run = model.scorer()
        for mark, z in zip(batch.column("toxic").to_pylist(), run(batch.column("text").to_pylist()), strict=True):
            yield {"label": mark, "features": z}

    rows = store_table(_map(sample, "label double, features array<double>", document_rows).select(
        "label", array_to_vector("features").alias("features")), "toxicity-documents")
    fitted = LogisticRegression(maxIter=30, regParam=1e-4).fit(rows)
    model.calibration = np.r_[fitted.coefficients.toArray(), fitted.intercept]
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of the label, from the whole text alone.

    One pass without a shuffle. A null or empty text has no sentence and gets the score of a text that
    matches nothing. All columns are kept; one called like the score is replaced.
    """
    columns = [c for c in docs.columns if c.lower() != name.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [t or "" for t in part.column(text).to_pylist()]
                found = [model.probability(z) for z in score(texts)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())],
                                                 names=[*part.schema.names, name])

    kept = docs.select(*[F.col(f"`{c}`") for c in columns])
    schema = kept.limit(0).withColumn(name, F.lit(0.0)).schema
    return kept.mapInArrow(run, schema)
