"""The subject areas of each document.

Subject terms and their weights come from people's labels, on a bounded sample: the sentences of
labelled documents are dealt to the labels, a term's weight is the logarithm of how much more
often it stands in sentences of its subject than in those of any other, and both steps are
repeated until they agree.  A term's rarity is counted over all documents.  A multi-pattern
automaton finds the terms of a whole text in one pass; each sentence goes to the subject with the
greatest weight, and a subject is assigned if its sentences make up a large enough part, by
length, of all sentences that have a subject.  That part is calibrated, for each subject, on
labelled documents which the weights weren't made from.  Terms (words and phrases of two), weights
and parts are two tables, which can be read, corrected and used again.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled documents that are collected to the driver, and the bytes of the longest of them; one in CALIBRATE of them sets the shares.
MOST_LABELLED, MOST_TEXT, CALIBRATE = 8_000, 1 << 14, 4
#: Labelled sentences that a phrase of two words must stand in to be a term.
PHRASE_USES = 8
#: Repetitions of dealing and weighing; the weight that a term must exceed; the least weight of a sentence.
ROUNDS, OFFSET, LEAST = 8, 0.7, 0.5
#: Shares among which the calibration chooses.
SHARES = tuple(round(0.10 + 0.01 * i, 2) for i in range(21))
#: The share without any calibration, and how much less F1 counts as equal for a single subject.
SHARE, EQUAL = 0.2, 0.005
#: A term in more than this part of all documents loses weight, in proportion to the logarithm of its frequency.
COMMON = 0.05

_END = re.compile(r'[\r\n]+|(?<=[.!?])["\')]*[\s,]+|</?[a-z]+>|",\s*"|"\s*:\s*|; ')
#: Texts without marks are cut between words into parts of about so many characters.
LONGEST, PART = 200, 80
_WORD = re.compile(r"[^\W\d_]{2,}")


def normal(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower()


def sentences(text: str) -> list[tuple[int, int]]:
    """Where the sentences of a normal text begin and end; lines, list items and string values end one too.

    A sentence of more than LONGEST characters is cut between words, as one without marks may be
    about several things.
    """
    out: list[tuple[int, int]] = []

    def add(a: int, b: int) -> None:
        while b - a > LONGEST and (cut := text.find(" ", a + PART, b)) > 0:
            out.append((a, cut))
            a = cut + 1
        if b > a:
            out.append((a, b))

    start = 0
    for m in _END.finditer(text):
        add(start, m.start())
        start = m.end()
    add(start, len(text))
    return out


@dataclass
class Terms:
    """Weighted terms; ``weights``: term -> (subject number, weight)."""

    subjects: list[str]
    weights: dict[str, tuple[int, float]]
    shares: list[float] = field(default_factory=list)
    _automaton: object = field(default=None, repr=False)

    def __post_init__(self):
        self.shares = self.shares or [SHARE] * len(self.subjects)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            made = ahocorasick.Automaton()
            for number, (term, (subject, weight)) in enumerate(self.weights.items()):
                made.add_word(term, (number, len(term), subject, weight))
            if self.weights:
                made.make_automaton()
            self._automaton = made
        return self._automaton

    def hits(self, text: str) -> Iterator[tuple[int, int, int, float]]:
        """Start, term number, subject and weight of each term that stands in a normal text as a word."""
        if not self.weights:
            return
        last = len(text) - 1
        for end, (number, length, subject, weight) in self.automaton().iter(text):
            start = end - length + 1
            if (start == 0 or not text[start - 1].isalpha()) and (end == last or not text[end + 1].isalpha()):
                yield start, number, subject, weight

    def lengths(self, text: str) -> np.ndarray:
        """The characters of the sentences of each subject in a normal text."""
        out, spans = np.zeros(len(self.subjects)), None
        scores: dict[int, dict[int, tuple[int, float]]] = {}
        for start, number, subject, weight in self.hits(text):
            if spans is None:
                spans = sentences(text)
                begins = [a for a, _ in spans]
            scores.setdefault(bisect_right(begins, start) - 1, {})[number] = (subject, weight)
        for at, terms in scores.items():
            total: dict[int, float] = {}
            for subject, weight in terms.values():
                total[subject] = total.get(subject, 0.0) + weight
            subject, best = min(total.items(), key=lambda x: (-x[1], x[0]))
            if best > LEAST:
                out[subject] += spans[at][1] - spans[at][0]
        return out

    def assigned(self, text: str | None) -> list[int]:
        """The subjects of a text; none of NULL, of a blank one and of one without subject terms."""
        if not text or not text.strip():
            return []
        lengths = self.lengths(normal(text))
        total = lengths.sum()
        return [int(s) for s in np.flatnonzero((lengths > 0) & (lengths >= np.array(self.shares) * total))]

    def store(self, spark: SparkSession, folder: str) -> None:
        """Writes the tables terms (term, subject, weight) and shares (subject, share)."""
        terms = [(t, self.subjects[s], w) for t, (s, w) in self.weights.items()]
        spark.createDataFrame(terms, "term string, subject string, weight double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/terms")
        spark.createDataFrame(list(zip(self.subjects, self.shares)), "subject string, share double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/shares")

    @classmethod
    def stored(cls, spark: SparkSession, folder: str) -> Terms:
        """The terms of two such tables, made by ``learn`` or by hand: a list for people to read, which every worker holds."""
        shares = {r["subject"]: r["share"] for r in spark.read.parquet(f"{folder}/shares").collect()}
        names = sorted(shares)
        rows = spark.read.parquet(f"{folder}/terms").where(F.col("subject").isin(names) & (F.col("weight") > 0)).collect()
        return cls(names, {normal(r["term"]): (names.index(r["subject"]), r["weight"]) for r in rows}, [shares[n] for n in names])


def terms_of(sentence: str) -> set[str]:
    """The words of a normal sentence, and the phrases of two words with a space between."""
    found = list(_WORD.finditer(sentence))
    return {m.group() for m in found} | {sentence[a.start() : b.end()] for a, b in zip(found, found[1:]) if sentence[a.end() : b.start()] == " "}


def fit(subjects: list[str], labelled: list[tuple[str, set[int]]]) -> Terms:
    """The terms of labelled texts."""
    vocabulary: dict[str, int] = {}
    raw: list[tuple[set[int], set[str]]] = []
    uses: Counter[str] = Counter()
    for text, labels in labelled:
        text = normal(text)
        for a, b in sentences(text):
            if labels and (words := terms_of(text[a:b])):
                uses.update(w for w in words if " " in w)
                raw.append((labels, words))
    segments = [(labels, sorted(vocabulary.setdefault(w, len(vocabulary)) for w in sorted(words) if " " not in w or uses[w] >= PHRASE_USES)) for labels, words in raw]
    if not segments:
        return Terms(subjects, {})
    k, rows = len(subjects), np.repeat(np.arange(len(segments)), [len(w) for _, w in segments])
    terms = np.concatenate([w for _, w in segments])
    own = np.zeros((len(segments), k))
    for i, (labels, _) in enumerate(segments):
        own[i, sorted(labels)] = 1
    part, favour = own / own.sum(axis=1, keepdims=True), np.where(own > 0, 1.0, 0.6)
    for _ in range(ROUNDS):
        counts = np.zeros((len(vocabulary), k))
        np.add.at(counts, terms, part[rows])
        total = part.sum(axis=0)
        usual = max(1.0, total.mean())
        rate = counts / np.maximum(total, usual / 4) + 0.5 / usual  # half a sentence of an average subject is added everywhere
        best, order = rate.argmax(axis=1), np.sort(rate, axis=1)
        second = order[:, -2] if k > 1 else np.full(len(order), rate.min())
        weight = np.where(counts.sum(axis=1) >= 2, np.maximum(np.log(order[:, -1] / second) - OFFSET, 0), 0)
        score = np.zeros((len(segments), k))
        np.add.at(score, (rows, best[terms]), weight[terms])
        score *= favour
        top = score.max(axis=1)
        part = ((score == top[:, None]) & (top[:, None] > LEAST)).astype(float)
        part /= np.maximum(1, part.sum(axis=1, keepdims=True))
    return Terms(subjects, {w: (int(best[i]), float(weight[i])) for w, i in vocabulary.items() if weight[i] > 0})


def calibrate(terms: Terms, labelled: list[tuple[str, set[int]]]) -> list[float]:
    """For each subject, of the shares that are as good as its best on labelled texts (by F1), the one nearest to the best for all subjects.

    Without any text, the default.
    """
    if not labelled or not terms.weights:
        return terms.shares
    lengths = np.array([terms.lengths(normal(t)) for t, _ in labelled])
    share = lengths / np.maximum(1, lengths.sum(axis=1, keepdims=True))
    wanted = np.zeros(share.shape, dtype=bool)
    for i, (_, labels) in enumerate(labelled):
        wanted[i, sorted(labels)] = True
    got = np.array([(share >= s) & (share > 0) for s in SHARES])
    hits, sizes = (got & wanted).sum(axis=1), got.sum(axis=1) + wanted.sum(axis=0)  # of each share and subject
    good = lambda f, slack: [s for s, x in zip(SHARES, f) if x >= f.max() - slack]
    every = good(2 * hits.sum(axis=1) / np.maximum(1, sizes.sum(axis=1)), 0.001)
    usual = every[len(every) // 2]
    return [min(good(f, EQUAL), key=lambda s: abs(s - usual)) for f in (2 * hits / np.maximum(1, sizes)).T]


def labelled_sample(documents: DataFrame, labels: DataFrame, subjects: list[str], most: int = MOST_LABELLED) -> list[tuple[str, set[int]]]:
    """Texts and labels of at most ``most`` labelled documents, those whose ids have the smallest hash; of these none of more than MOST_TEXT bytes.

    Labels are compared without letter case and outer white space; others than ``subjects`` don't count.
    """
    numbers = {s: i for i, s in enumerate(subjects)}
    named = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject")).where(F.col("subject").isin(subjects) & F.col("doc_id").isNotNull())
    chosen = named.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = documents.select("doc_id", "text").where(F.octet_length("text") <= MOST_TEXT).join(F.broadcast(chosen), "doc_id")  # at most `most` rows
    return [(r["text"], {numbers[s] for s in r["subjects"]}) for r in texts.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]


def document_frequency(documents: DataFrame, terms: Terms) -> tuple[int, dict[str, int]]:
    """The number of all documents, and of those that hold each term."""
    shared = documents.sparkSession.sparkContext.broadcast(terms)
    names = list(terms.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(len(names) + 1, dtype=np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                if text and (found := {number for _, number, _, _ in shared.value.hits(normal(text))}):
                    counts[list(found)] += 1
                n += 1
        counts[-1] = n
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], names=["term", "n"])

    totals = documents.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in totals.collect()}  # at most a row for each term
    return found.get(len(names), 0), {w: found.get(i, 0) for i, w in enumerate(names)}


def weigh_rarity(terms: Terms, documents: int, frequency: dict[str, int]) -> Terms:
    """Lowers the weights of terms that stand in more than a COMMON part of all documents."""
    common = max(1.0, COMMON * documents)
    factor = {w: min(1.0, np.log(max(2.0, documents) / max(1, frequency.get(w, 0))) / np.log(max(2.0, documents) / common)) if documents else 1.0 for w in terms.weights}
    return Terms(terms.subjects, {w: (s, float(v * factor[w])) for w, (s, v) in terms.weights.items() if factor[w] > 0}, terms.shares)


def learn(documents: DataFrame, labels: DataFrame, subjects: DataFrame, most: int = MOST_LABELLED) -> Terms:
    """Terms, weights and shares, for the closed list of subjects, all of it in the driver."""
    names = sorted({r[0] for r in subjects.select(F.lower(F.trim("subject"))).where("subject is not null").distinct().collect()})
    sample = labelled_sample(documents, labels, names, most)
    held = sample[::CALIBRATE]
    terms = fit(names, [x for i, x in enumerate(sample) if i % CALIBRATE])
    terms = weigh_rarity(terms, *document_frequency(documents, terms))
    terms.shares = calibrate(terms, held)
    return terms


def assign(documents: DataFrame, terms: Terms) -> DataFrame:
    """doc_id, subject for each subject of each document."""
    shared = documents.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value.subjects
        for batch in batches:
            docs, found = [], []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = shared.value.assigned(value.as_py())
                docs += [doc] * len(own)
                found += [names[s] for s in own]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.string())], names=["doc_id", "subject"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, subject string")


def composition(documents: DataFrame, assigned: DataFrame) -> DataFrame:
    """source, lang, subject, docs, share: how many documents of each source and language have each subject.

    ``lang`` is the first part of the tag in lower case, 'unknown' if there is none.  Documents
    with several subjects count for each; ``share`` is the part of the group's documents.
    """
    lang = F.coalesce(F.lower(F.substring_index(F.regexp_replace(F.nullif(F.trim("lang"), F.lit("")), "_", "-"), "-", 1)), F.lit("unknown"))
    rows = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), lang.alias("lang"))
    total = rows.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("all_docs"))
    counts = rows.join(assigned, "doc_id").groupBy("source", "lang", "subject").agg(F.count(F.lit(1)).alias("docs"))
    return counts.join(total, ["source", "lang"]).select("source", "lang", "subject", "docs", F.round(F.col("docs") / F.col("all_docs"), 6).alias("share"))
