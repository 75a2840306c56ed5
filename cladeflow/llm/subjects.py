"""Subject areas of each document by subject-specific interpolated n-gram language models.

For every subject a bigram model of its sentences is trained, interpolated by Witten-Bell weights with its unigrams and
with a model of all sentences. A sentence's gain for a subject is its length times the difference of per-token
cross-entropies, background less subject; the background models of a subject are those of the other subjects and of all
sentences, mixed, so that what all subjects have in common gains nothing. Sentences whose best gain reaches a calibrated
threshold of that subject bear a subject; which one is told by the models and by the shares of the subjects in the rest of the document.
A document has every subject that at least a quarter of its subject-bearing sentences treat.

The labels are of documents, incomplete and partly wrong, while models are of sentences: training starts with all
sentences of a document under its labels, then assigns the sentences anew by the models and trains on those, a few times.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import latex

#: Labelled documents that the models are fitted on, at most this many for each subject, chosen by a hash of the id.
FIT_PER_SUBJECT = 400
#: Labelled documents with longer texts are not fitted on (they are classified whole, as all are).
FIT_MAX_CHARS = 200_000
#: Words that the models are fitted on at most, in order of the hash: some 100 MB on the driver, models included.
FIT_WORDS = 4_000_000
#: Parts of the labelled documents; each is held out once while the thresholds are chosen.
PARTS = 2
#: Part of the background in each subject's model.
MIX = 0.3
ROUNDS = 4
#: Gains (in nats) that the threshold is chosen among.
THRESHOLDS = (1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0)
#: Gain (in nats) needed while training.
FIRST_THRESHOLD = 1.5
#: Share of a document's subject-bearing sentences that a subject needs.
SHARE = 0.25
_FOLDS = 64


@dataclass
class Sentences:
    """Tokens of many documents: word numbers (0 is a sentence's start, 1 an unknown word), and where they belong."""

    word: np.ndarray
    before: np.ndarray
    starts: np.ndarray
    doc: np.ndarray
    docs: int

    @property
    def of(self) -> np.ndarray:
        """The sentence of each token."""
        return np.repeat(np.arange(len(self.starts)), np.diff(np.r_[self.starts, len(self.word)]))


def number(docs: list[list[str]], vocabulary: dict[str, int]) -> Sentences:
    """``docs`` (as of :func:`latex.words`) in word numbers; sentences without words are left out."""
    get, flat, owner = vocabulary.get, [], np.zeros(len(docs), np.int64)
    for i, words in enumerate(docs):
        flat += [get(w, 1) for w in words]
        flat.append(0)
        owner[i] = len(words) + 1
    return _sentences(np.array(flat, np.int64), owner)


def _sentences(tokens: np.ndarray, owner: np.ndarray) -> Sentences:
    """From word numbers, and the number of them (an end of sentence at each document's end among them) by document."""
    doc = np.repeat(np.arange(len(owner)), owner)
    is_word = tokens != 0
    before = np.r_[0, tokens[:-1]][is_word] if len(tokens) else tokens
    sentence = np.cumsum(~is_word)[is_word]
    starts = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]]) if len(sentence) else np.zeros(0, np.int64)
    return Sentences(tokens[is_word], before, starts, doc[is_word][starts] if len(starts) else starts, len(owner))


def _models(s: Sentences, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From sentences with weights (sentence x subject): bigram keys, and log ratios of subject to background for seen
    bigrams, for words after an unseen bigram's context, and of the words themselves."""
    subjects = weight.shape[1]
    of = s.of
    key = s.before * size + s.word
    keys, at = np.unique(key, return_inverse=True)
    pairs = np.stack([np.bincount(at, weight[of, k], len(keys)) for k in range(subjects)] + [np.bincount(at, minlength=len(keys)).astype(float)], 1)
    left, right = keys // size, keys % size
    words = np.stack([np.bincount(right, pairs[:, k], size) for k in range(subjects + 1)], 1)
    context = np.stack([np.bincount(left, pairs[:, k], size) for k in range(subjects + 1)], 1)
    kinds = np.stack([np.bincount(left, pairs[:, k] > 0, size) for k in range(subjects + 1)], 1)
    flat = np.full((size, 1), 1.0 / size)
    total = words.sum(0)
    types = (words > 0).sum(0)
    unigram = (words + types * flat) / np.maximum(total + types, 1e-9)
    unigram[:, :-1] = (1 - MIX) * unigram[:, :-1] + MIX * unigram[:, -1:]
    rest = np.where(context > 0, kinds / np.maximum(context + kinds, 1e-9), 1.0)
    seen = (1 - rest[left]) * pairs / np.maximum(context[left], 1e-9) + rest[left] * unigram[right]
    seen[:, :-1] = (1 - MIX) * seen[:, :-1] + MIX * seen[:, -1:]
    pair_gain = np.log(seen[:, :-1]) - np.log(seen[:, -1:])
    # a bigram that nothing has: the ratio of its words alone
    word_gain = np.log(unigram[:, :-1]) - np.log(unigram[:, -1:])
    word_gain[1] = 0.0
    return keys, pair_gain.astype(np.float32), word_gain.astype(np.float32), total


@dataclass
class Models:
    """Trained models: ``subjects`` in order, the vocabulary, gains of bigrams and words, and each subject's threshold."""

    subjects: list[str]
    vocabulary: dict[str, int]
    keys: np.ndarray
    pair_gain: np.ndarray
    word_gain: np.ndarray
    thresholds: np.ndarray | float = FIRST_THRESHOLD

    def ratios(self, s: Sentences) -> np.ndarray:
        """Log ratio of each sentence's probability by each subject's model to that by the model of all sentences."""
        if not len(s.starts):
            return np.zeros((0, len(self.subjects)), np.float32)
        key = s.before * (len(self.vocabulary) + 1) + s.word
        i = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        seen = self.keys[i] == key
        each = np.where(seen[:, None], self.pair_gain[i], self.word_gain[s.word])
        return np.add.reduceat(each, s.starts, axis=0)

    @staticmethod
    def gains(ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best gain of each sentence over a subject's background models, and which subject's it is."""
        if not len(ratios):
            return np.zeros(0), np.zeros(0, np.int64)
        x = np.c_[ratios.astype(np.float64), np.zeros(len(ratios))]  # the last is the model of all sentences
        best = x[:, :-1].argmax(1)
        own = x[np.arange(len(x)), best]
        x[np.arange(len(x)), best] = -np.inf
        top = x.max(1)
        return own - (top + np.log(np.exp(x - top[:, None]).sum(1) / (x.shape[1] - 1))), best

    def assign(self, s: Sentences, ratios: np.ndarray, thresholds: np.ndarray | float | None = None) -> np.ndarray:
        """Subject of each sentence, -1 of one that bears none; documents' other sentences weigh in."""
        gain, best = self.gains(ratios)
        bears = gain >= np.broadcast_to(self.thresholds if thresholds is None else thresholds, len(self.subjects))[best]
        g, doc = ratios[bears].astype(np.float64), s.doc[bears]
        k = len(self.subjects)
        prior = np.full((s.docs, k), 1.0 / k)
        for _ in range(4):
            x = g + np.log(prior[doc])
            p = np.exp(x - x.max(1, keepdims=True)) if len(x) else x
            p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
            sums = np.stack([np.bincount(doc, p[:, j], s.docs) for j in range(k)], 1)
            prior = (sums + 0.02) / (sums.sum(1, keepdims=True) + 0.02 * k)
        out = np.full(len(ratios), -1)
        if len(g):
            out[bears] = (g + np.log(prior[doc])).argmax(1)
        return out

    def shares(self, s: Sentences, assigned: np.ndarray) -> np.ndarray:
        """Share of each subject among the subject-bearing sentences of each document; 0 where there are none."""
        held = assigned >= 0
        counts = np.zeros((s.docs, len(self.subjects)))
        np.add.at(counts, (s.doc[held], assigned[held]), 1)
        return counts / np.maximum(counts.sum(1, keepdims=True), 1)

    def accepted(self, docs: list[list[str]]) -> list[list[int]]:
        """Numbers of the subjects of each document."""
        s = number(docs, self.vocabulary)
        shares = self.shares(s, self.assign(s, self.ratios(s)))
        return [np.flatnonzero(row >= SHARE - 1e-9).tolist() for row in shares]


def _train(s: Sentences, given: np.ndarray, subjects: list[str], vocabulary: dict[str, int]) -> Models:
    """Models of sentences whose documents have the labels ``given`` (document x subject)."""
    size = len(vocabulary) + 1
    weight = (given / np.maximum(given.sum(1, keepdims=True), 1))[s.doc]
    models = None
    for turn in range(ROUNDS + 1):
        keys, pair_gain, word_gain, _ = _models(s, weight, size)
        models = Models(subjects, vocabulary, keys, pair_gain, word_gain)
        if turn < ROUNDS:
            assigned = models.assign(s, models.ratios(s), FIRST_THRESHOLD)
            weight = np.zeros_like(weight)
            weight[np.flatnonzero(assigned >= 0), assigned[assigned >= 0]] = 1
    return models


def _accepted(models: Models, s: Sentences) -> list[np.ndarray]:
    """For each of THRESHOLDS, which subjects documents have (document x subject)."""
    ratios = models.ratios(s)
    return [models.shares(s, models.assign(s, ratios, t)) >= SHARE - 1e-9 for t in THRESHOLDS]


def _thresholds(found: list[np.ndarray], given: np.ndarray) -> np.ndarray:
    """For each subject the lowest threshold with which its acceptance agrees with labels as well as with the best, but
    for what one document more or less makes. Subjects without labels have that of all together."""
    agree = lambda cut: [2 * (f[:, cut] & (given[:, cut] > 0)).sum() / max(f[:, cut].sum() + given[:, cut].sum(), 1) for f in found]
    lowest = lambda a, n: next(t for t, x in zip(THRESHOLDS, a) if x >= max(a) - max(0.005, 1 / n))
    counts = given.sum(0)
    common = lowest(agree(slice(None)), max(given.sum(), 1))
    return np.array([lowest(agree(slice(k, k + 1)), n) if n else common for k, n in enumerate(counts)])


def _part(s: Sentences, docs: np.ndarray) -> Sentences:
    """The sentences of the documents chosen (a mask), which keep their numbers."""
    kept = docs[s.doc]
    words = kept[s.of]
    lengths = np.diff(np.r_[s.starts, len(s.word)])[kept]
    return Sentences(s.word[words], s.before[words], np.cumsum(lengths) - lengths, s.doc[kept], s.docs)


def fit(docs: list[list[str]] | pa.ListArray, labels: list[list[str]], subjects: list[str]) -> Models:
    """Models from labelled documents. Without labelled documents none has a subject.

    Each subject's threshold is calibrated on all documents, each by models that it was held out from; the models given
    are trained on all.
    """
    lists = docs if isinstance(docs, pa.ListArray) else pa.array(docs, pa.list_(pa.string()))
    coded = lists.flatten().dictionary_encode()
    names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    counts = np.bincount(codes, minlength=len(names))
    vocabulary = {latex.END: 0} | {w: i + 2 for i, w in enumerate(sorted(w for w, n in zip(names, counts) if n > 1 and w != latex.END))}
    numbers = np.array([vocabulary.get(w, 1) for w in names], np.int64)
    owner = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    s = _sentences(np.insert(numbers[codes] if len(codes) else np.zeros(0, np.int64), np.cumsum(owner), 0), owner + 1)
    place = {name: k for k, name in enumerate(subjects)}
    given = np.zeros((len(owner), len(subjects)))
    for i, own in enumerate(labels):
        for name in own:
            given[i, place[name]] = 1
    if not len(s.starts):
        empty = np.zeros((len(vocabulary) + 1, len(subjects)), np.float32)
        return Models(subjects, vocabulary, np.array([-1]), np.zeros((1, len(subjects)), np.float32), empty, np.inf)
    models = _train(s, given, subjects, vocabulary)
    found = [np.zeros(given.shape, bool) for _ in THRESHOLDS]
    for i in range(PARTS):
        held = np.arange(len(owner)) % PARTS == i
        rest, out = _part(s, ~held), _part(s, held)
        if len(rest.starts) and len(out.starts):
            found = [a | b for a, b in zip(found, _accepted(_train(rest, given, subjects, vocabulary), out))]
    models.thresholds = _thresholds(found, given)
    return models


def fit_sample(labels: DataFrame, documents: DataFrame, per_subject: int = FIT_PER_SUBJECT) -> pa.Table:
    """``words`` and ``subjects`` of the documents to fit on, in order of a hash: a sample of bounded size, spread over the
    subjects. What goes to the driver is at most FIT_WORDS words."""
    # each subject's labels are ranked in parts, of which only the first few leave the tasks that read them
    quota = max(1, -(-per_subject // _FOLDS))
    parts = labels.filter(F.col("doc_id").isNotNull() & F.col("subject").isNotNull()).select("doc_id", "subject").distinct()
    parts = parts.withColumn("h", F.xxhash64("doc_id")).withColumn("fold", F.pmod("h", F.lit(_FOLDS)))
    place = F.row_number().over(Window.partitionBy("subject", "fold").orderBy("h", "doc_id"))
    chosen = parts.withColumn("place", place).filter(F.col("place") <= quota).select("doc_id").distinct()
    sample = parts.join(chosen, "doc_id", "left_semi").groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    # at most per_subject + _FOLDS documents a subject, each with its subjects: small by construction
    texts = documents.filter(F.col("text").isNotNull() & (F.length("text") <= FIT_MAX_CHARS)).select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    texts = texts.select("h", "doc_id", "text", "subjects")
    schema = T.StructType([texts.schema["h"], texts.schema["doc_id"], T.StructField("words", T.ArrayType(T.StringType())), T.StructField("subjects", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([latex.words(x) for x in batch.column(2).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], words, batch.column(3)], names=schema.names)

    found = texts.mapInArrow(run, schema)
    upto = F.sum(F.size("words")).over(Window.orderBy("h", "doc_id"))
    return found.withColumn("upto", upto).filter(F.col("upto") <= FIT_WORDS).sort("h", "doc_id").select("words", "subjects").toArrow()


def train(labels: DataFrame, documents: DataFrame, subjects: DataFrame, per_subject: int = FIT_PER_SUBJECT) -> Models:
    """Models for the ``subjects`` table (a few rows) from ``labels`` (doc_id, subject) of ``documents`` (doc_id, text)."""
    names = sorted({r["subject"] for r in subjects.select("subject").collect() if r["subject"] is not None})
    sample = fit_sample(labels.filter(F.col("subject").isin(names)), documents, per_subject)
    words = sample.column("words").combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.string()))
    words = words if isinstance(words, pa.ListArray) else pa.concat_arrays(words.chunks)
    return fit(words, sample.column("subjects").to_pylist(), names)


def document_subjects(documents: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``subject``, a row for each subject that a document has.

    Null, empty and blank texts and texts without subject-bearing sentences have none. A row is classified each time that
    it occurs; null ids stay null; an empty table gives no rows; other columns are not read. Every text is read whole, and
    nothing is shuffled.
    """
    rows = documents.filter(F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("subject", T.StringType())])
    shared = documents.sparkSession.sparkContext.broadcast(models)  # bounded by the sample that the models are fitted on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = models.accepted([latex.words(x) for x in part.column(1).to_pylist()])
                ids = part.column(0).take(pa.array([i for i, x in enumerate(found) for _ in x], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([models.subjects[k] for x in found for k in x], pa.string())], names=["id", "subject"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
