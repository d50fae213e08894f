"""Toxicity by compression distance: two zstandard dictionaries, of toxic and of ordinary text, and calibrated lengths.

A window is a word; words over 64 bytes are several windows. It is compressed twice, with each dictionary, between two fixed
strings that both dictionaries hold: zstandard compresses no block that gains too little and looks for no match in a block's last
bytes, and so the length beyond that of the fixed strings is the window's own. A window's cell is its length and its two compressed lengths; what a
cell says of a document is the logarithm of its rates in toxic and ordinary documents. A document's score is a logistic
function of the largest, the mean and the number of its windows' values.

The toxic dictionary holds words with byte n-grams that set toxic documents apart, those last that do so most. The ordinary
dictionary holds the commonest words of ordinary documents that the toxic dictionary shortens: it wins where a likeness is chance.
Dictionaries for calibration are learned from two thirds of the sample and applied to the rest, so no document is
measured by its own words; those for use are learned from all of it.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import rest, slices
from granary.llm.langid import held_out

#: Learned from at most so many different labelled texts of each kind, of at most so many characters each.
TOXIC, ORDINARY, CHARS = 1000, 2000, 20_000
HEAD, TAIL = b"0123456789ABCDEFGHIJKLMNOPQRSTUV", b"VUTSRQPONMLKJIHGFEDCBA9876543210"
LEVEL, GRAM, FOLDS, TOP = 9, 6, 3, 8
TOXIC_BYTES, ORDINARY_BYTES, LONG, CACHE, PIECE = 16 << 10, 64 << 10, 64, 1 << 18, 4 << 20
#: A toxic n-gram is in so many more standard errors, times as many and so many toxic documents, after so many words each document.
ERRORS, TIMES, DOCS, AFTER = 4.0, 3.0, 3, 0.6
_LETTERS = bytes(c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def windows(text: bytes | None) -> list[bytes]:
    """Words in lower case, runs of ASCII letters and of characters past ASCII, in pieces of at most LONG bytes."""
    found = (text or b"").decode("utf-8", "replace").lower().encode().translate(_LETTERS).split()
    if found and max(map(len, found)) > LONG:
        return [w[i : i + LONG] for w in found for i in range(0, len(w), LONG)]
    return found


def pieces(text: bytes | None, limit: int = PIECE) -> Iterator[bytes | None]:
    """Parts of a text of at most about `limit` bytes, cut before white space or, where there is none, between characters."""
    while text is not None and len(text) > limit:
        at = max(text.rfind(b" ", limit // 2, limit), text.rfind(b"\n", limit // 2, limit))
        if at < 0:
            at = limit
            while text[at] & 0xC0 == 0x80:
                at -= 1
        yield text[:at]
        text = text[at:]
    yield text


def grams(text: bytes) -> np.ndarray:
    """Byte n-grams as numbers."""
    c = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = max(0, len(c) - GRAM + 1)
    found = np.zeros(n, np.uint64)
    for i in range(GRAM):
        found = (found << np.uint64(8)) | c[i : i + n]
    return found


def _spaced(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


def toxic_words(texts: list[list[bytes]], found: list[np.ndarray], toxic: np.ndarray) -> list[bytes]:
    """Words of toxic texts that hold an n-gram which sets these apart, the surest last; found: each text's different n-grams."""
    n = np.array([(~toxic).sum(), toxic.sum()], float)
    every, held = np.unique(np.concatenate([g for g, y in zip(found, toxic) if y]), return_counts=True)
    every, held = every[held >= DOCS], held[held >= DOCS]  # others can't set texts apart
    docs = [np.zeros(len(every), np.int64), held]
    for g, y in zip(found, toxic):  # counted text by text: the n-grams of all ordinary texts are never held at once
        if not y and len(every):
            at = np.searchsorted(every, g)
            at[at == len(every)] = 0
            docs[0][at[every[at] == g]] += 1
    share = (docs[0] + docs[1]) / n.sum()
    errors = (docs[1] / n[1] - docs[0] / n[0]) / np.sqrt(share * (1 - share) * (1 / n).sum() + 1e-9)
    times = (docs[1] + 0.5) / (n[1] + 1) / ((docs[0] + 0.5) / (n[0] + 1))
    apart = (errors > ERRORS) & (times > TIMES)
    names = [g.to_bytes(GRAM, "big") for g in every[apart].tolist()]
    sure, held = dict(zip(names, errors[apart].tolist())), dict(zip(names, docs[1][apart].tolist()))
    after: dict[bytes, set[bytes]] = defaultdict(set)
    has: dict[bytes, list[bytes]] = {}
    for t, y in zip(texts, toxic):
        for before, w in zip([b"", *t], t) if y else ():
            if w not in has:
                spaced = _spaced([w])
                has[w] = [g for i in range(len(spaced) - GRAM + 1) if (g := spaced[i : i + GRAM]) in sure]
            for g in has[w]:
                after[g].add(before)
    good = {g for g, words in after.items() if len(words) >= max(DOCS, AFTER * held[g])}  # else copies of one text
    value = {w: max((sure[g] for g in grams if g in good), default=0.0) for w, grams in has.items()}
    return sorted((w for w, v in value.items() if v), key=lambda w: (value[w], w))


class Sizes:
    """Lengths of windows compressed with a dictionary."""

    def __init__(self, content: bytes) -> None:
        known = zstandard.ZstdCompressionDict(TAIL + content + HEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress
        self.fixed = len(self.compress(HEAD + TAIL))

    def __call__(self, word: bytes) -> int:
        return max(0, len(self.compress(HEAD + b" " + word + b" " + TAIL)) - self.fixed)


def dictionaries(texts: list[list[bytes]], found: list[np.ndarray], toxic: np.ndarray) -> tuple[bytes, bytes]:
    """Contents of the toxic and of the ordinary dictionary."""
    own = toxic_words(texts, found, toxic)
    content = _spaced(own)[-TOXIC_BYTES:]
    short, held, like, size = Sizes(content), set(own), [], 0
    counts = Counter(w for t, y in zip(texts, toxic) if not y for w in set(t))
    for w in sorted(counts, key=lambda w: (-counts[w], w)):
        if size >= ORDINARY_BYTES:
            break
        if w not in held and short(w) < len(w) + 2:
            like.append(w)
            size += len(w) + 1
    return content, _spaced(like[::-1])


class Cells(dict):
    """word: its cell. Missing words are compressed, and remembered up to a bound."""

    def __init__(self, contents: tuple[bytes, bytes]) -> None:
        self.toxic, self.ordinary = map(Sizes, contents)

    def __missing__(self, word: bytes) -> int:
        cell = (len(word) * 128 + min(self.ordinary(word), 127)) * 128 + min(self.toxic(word), 127)
        if len(self) < CACHE:
            self[word] = cell
        return cell

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def cell_values(cells: list[np.ndarray], toxic: np.ndarray) -> dict[int, float]:
    """Log ratio of a cell's rates in toxic and ordinary documents; a document counts once a cell. Two pseudo-documents are shared out."""
    docs, size = [Counter(), Counter()], np.zeros(2)
    for c, y in zip(cells, toxic):
        docs[int(y)].update(np.unique(c).tolist())
        size[int(y)] += len(c)
    more = 2 * size / size.sum()
    return {c: float(np.log((docs[1][c] + more[1]) / size[1]) - np.log((docs[0][c] + more[0]) / size[0])) for c in {*docs[0], *docs[1]}}


def summed(values: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the windows of each of n texts, and each text's TOP largest values; both can be merged."""
    over = np.maximum(values - 1, 0)
    sums = np.stack([np.bincount(at, w, n) for w in (np.ones(len(at)), values, over, values > 2, values > 3)], axis=1)
    order = np.lexsort((-values, at))
    place = np.arange(len(at)) - np.repeat(np.cumsum(sums[:, 0]) - sums[:, 0], sums[:, 0].astype(np.int64)).astype(np.int64)
    top, first = np.full((n, TOP), -np.inf), order[place < TOP]
    top[at[first], place[place < TOP]] = values[first]
    return sums, top


def features(sums: np.ndarray, top: np.ndarray) -> np.ndarray:
    n = np.maximum(sums[:, 0], 1)
    real = np.isfinite(top)
    means = [np.where(real[:, :k], top[:, :k], 0).sum(axis=1) / np.maximum(real[:, :k].sum(axis=1), 1) for k in (1, 2, 4, TOP)]
    return np.stack([*means, sums[:, 1] / n, sums[:, 2] / n, np.log1p(sums[:, 2]), np.log1p(sums[:, 3]), np.log1p(sums[:, 4]), sums[:, 3] / n, np.log1p(sums[:, 0])], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, deviations) of a ridge logistic fit by Newton's method."""
    mean, deviation = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / deviation]
    weight, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ weight, -30, 30)))
        weight -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ weight)
    return weight, mean, deviation


@dataclass
class Model:
    contents: tuple[bytes, bytes]
    values: dict[int, float]
    weight: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray

    def probabilities(self, sums: np.ndarray, top: np.ndarray) -> np.ndarray:
        """By document; 0 where it has no window."""
        z = self.weight[0] + (features(sums, top) - self.mean) / self.deviation @ self.weight[1:]
        return np.where(sums[:, 0] > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def _summed(cells: list[np.ndarray], values: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.concatenate(cells)
    kinds, at = np.unique(flat, return_inverse=True)
    return summed(np.array([values.get(k, 0.0) for k in kinds.tolist()])[at], np.repeat(np.arange(len(cells)), [len(c) for c in cells]), len(cells))


def fit(sample: list[tuple[bytes, bool]], share: float) -> Model | None:
    """From (text, whether toxic) and the share of toxic texts among all that are labelled; None without both kinds."""
    texts = [windows(t) for t, _ in sample]
    toxic = np.array([y for (_, y), t in zip(sample, texts) if t], bool)
    texts = [t for t in texts if t]
    if min(toxic.sum(), (~toxic).sum()) < FOLDS:
        return None
    fold = np.empty(len(toxic), np.int64)
    for kind in (False, True):  # each fold has its part of either kind
        fold[toxic == kind] = np.arange((toxic == kind).sum()) % FOLDS
    found = [np.unique(grams(_spaced(t))) for t in texts]
    cells: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    for f in range(FOLDS):
        others = np.flatnonzero(fold != f)
        known = Cells(dictionaries([texts[i] for i in others], [found[i] for i in others], toxic[others]))
        for i in np.flatnonzero(fold == f):
            cells[i] = known.of(texts[i])
    x = np.zeros((len(texts), features(np.zeros((1, 5)), np.zeros((1, TOP))).shape[1]))
    for f in range(FOLDS):
        values = cell_values([c for c, g in zip(cells, fold) if g != f], toxic[fold != f])
        x[fold == f] = features(*_summed([cells[i] for i in np.flatnonzero(fold == f)], values))
    weight, mean, deviation = logistic(x, toxic.astype(float))
    weight[0] += np.log(share / (1 - share)) - np.log(toxic.mean() / (1 - toxic.mean()))
    return Model(dictionaries(texts, found, toxic), cell_values(cells, toxic), weight, mean, deviation)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = TOXIC, ordinary: int = ORDINARY, chars: int = CHARS) -> Model | None:
    """A model from the labelled rows that are not held out; None if they lack a kind.

    It learns from at most `toxic` and `ordinary` different texts of at most `chars` characters, those with the smallest
    hashes, so a text with many copies counts once. Null ids and labels other than 0 and 1 teach nothing; an id with both
    labels is toxic. Texts don't move: rows of ids and hashes are joined, and only the chosen texts are fetched.
    """
    rows = docs.where(~held_out(id_col) & F.col(text_col).isNotNull() & (F.length(text_col) <= chars)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("kind"))
    each = rows.select("id", "hash").join(known, "id").groupBy("kind", "hash").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    total = {r.kind: r.n for r in each.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    if not (total.get(0) and total.get(1)):
        return None
    chosen = [r for kind, most in ((0, ordinary), (1, toxic)) for r in each.where(F.col("kind") == kind).orderBy("hash").limit(most).collect()]
    kinds = docs.sparkSession.createDataFrame([(r.id, r.hash, r.kind) for r in chosen], each.select("id", "hash", "kind").schema)
    texts = rows.join(F.broadcast(kinds), ["id", "hash"]).groupBy("kind", "hash").agg(F.first("text").alias("text")).collect()
    return fit([(r.text.encode(), r.kind == 1) for r in sorted(texts, key=lambda r: (r.hash, r.kind))], total[1] / (total[0] + total[1]))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row, from its whole text alone: the probability that its label is 1.

    Null texts and texts without a letter get 0, as do all rows where there is no model. Very long texts are read in pieces
    of 4 MB, whose sums and largest values are merged. Repeated rows get a row each and equal texts equal scores; other
    columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(id_col, text_col)
    schema = docs.select(id_col, F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cells = Cells(model.contents) if model else None
        for batch in batches:
            for begin, texts in slices(batch.column(1)):
                found = scores(model, cells, texts) if model else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), pa.array(found, pa.float64())], names=schema.names)
        rest()

    return docs.mapInArrow(run, schema)


def scores(model: Model, cells: Cells, texts: list[bytes | None]) -> np.ndarray:
    if len(texts) > 1 or len(texts[0] or b"") <= PIECE:
        return model.probabilities(*_summed([cells.of(windows(t)) for t in texts], model.values))
    sums, top = np.zeros((1, 5)), np.full((1, TOP), -np.inf)
    for part in pieces(texts[0]):
        s, t = _summed([cells.of(windows(part))], model.values)
        sums, top = sums + s, -np.sort(-np.concatenate([top, t], axis=1), axis=1)[:, :TOP]
    return model.probabilities(sums, top)
