"""Operator 1, language identification of words by a linear-chain conditional random field.

A word's features are its character bigrams and trigrams, its affixes of up to three characters, and the learned lexicons
that hold it; learned transitions link the labels of neighbouring words. Forward-backward gives each word's probability of
each language, so code-switched texts get runs of languages; a text's language has the largest mean probability.

Training takes a bounded sample of labelled rows (docs_per_lang, chars_per_doc) and makes sequences that switch between
passages of different documents, so that transitions are learned too. Scoring is exact forward-backward over whole texts:
words are laid out in blocks, the transfer matrices of all blocks are multiplied at once, and what goes in and out of each
block follows from them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_texts, slices

#: Rows of the table of hashed features; lexicon features have rows of their own after these.
HASHED = 1 << 16
#: Words in a block of forward-backward.
BLOCK = 32
#: Words whose scores a Python worker keeps.
CACHE = 200_000
UNKNOWN = "und"
#: Bytes of words (ASCII letters in lower case, all bytes past ASCII); others become spaces.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def letters(word: bytes) -> str:
    """A word's letters in lower case; characters past ASCII that aren't letters go."""
    s = word.decode()
    return s if s.isascii() else "".join(c for c in s if c.isalpha()).lower()


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word number) of the character n-grams and affixes of words."""
    c = np.frombuffer(("\2" + "\2".join(words) + "\2").encode("utf-32-le"), np.uint32).astype(np.uint64)
    edge = c == 2
    word = np.cumsum(edge) - 1
    found = []

    def put(kind: int, at: np.ndarray, length: int) -> None:
        h = np.full(len(at), kind, np.uint64)
        for i in range(length):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[at + i]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        found.append(((h >> np.uint64(48)).astype(np.int64) % HASHED, word[at]))

    n = len(c)
    put(2, np.arange(n - 1), 2)
    put(3, np.flatnonzero(~edge[1 : n - 1]), 3)
    inner = ~edge[1 : n - 2] & ~edge[2 : n - 1]
    put(4, np.flatnonzero(inner & (edge[: n - 3] | edge[3:])), 4)
    return np.concatenate([f for f, _ in found]), np.concatenate([w for _, w in found])


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # (HASHED + lexicons, langs)
    step: np.ndarray  # (langs, langs), log
    start: np.ndarray  # (langs,), log
    lexicon: dict[str, list[int]]
    seen: np.ndarray  # (HASHED,), whether the sample has the feature
    familiar: float  # the least share of seen features in a text of a learned language
    known: dict[bytes, int] = field(default_factory=dict)
    scores: np.ndarray | None = None  # log scores of known words, and last the share of their features that are seen

    def all_features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        f, w = features(words)
        own = [(HASHED + x, i) for i, word in enumerate(words) for x in self.lexicon.get(word, ())]
        if own:
            f, w = np.concatenate([f, [x for x, _ in own]]), np.concatenate([w, [i for _, i in own]])
        return f, w

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log scores of words for each language, and last the share of their features that the sample has."""
        f, w = self.all_features(words)
        own = f < HASHED
        share = np.bincount(w[own], self.seen[f[own]], len(words)) / np.maximum(np.bincount(w[own], minlength=len(words)), 1)
        return np.stack([*[np.bincount(w, self.weight[f, k], len(words)) for k in range(len(self.langs))], share], axis=1)

    def score_words(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(number of words with letters in each text, emissions of those words)."""
        new = list(set().union(*texts).difference(self.known))
        spelled = [letters(w) for w in new]
        real = [i for i, s in enumerate(spelled) if s]
        first = 0 if self.scores is None else len(self.scores)
        fresh = self.emissions([spelled[i] for i in real]) if real else np.zeros((0, len(self.langs) + 1))
        table = fresh if self.scores is None else np.concatenate([self.scores, fresh])
        self.known.update((w, -1) for w, s in zip(new, spelled) if not s)
        self.known.update((new[i], first + k) for k, i in enumerate(real))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), np.int64)
        text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        kept = at >= 0
        if len(self.known) > CACHE:
            for w in new:
                del self.known[w]
        else:
            self.scores = table
        return np.bincount(text[kept], minlength=len(texts)), table[at[kept]]


def marginals(counts: np.ndarray, scores: np.ndarray, step: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Each word's probability of each label by forward-backward; counts: words of each text, scores: of all words in order."""
    size = scores.shape[1]
    counts = counts[counts > 0]
    if not len(counts):
        return np.zeros((0, size))
    blocks = -(-counts // BLOCK)
    first = np.cumsum(blocks) - blocks  # block of each text
    within = np.arange(len(scores)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = np.repeat(first * BLOCK, counts) + within
    total = int(blocks.sum())
    e = np.ones((total * BLOCK, size))
    e[place] = np.exp(scores - scores.max(axis=1, keepdims=True))
    real = np.zeros(total * BLOCK, bool)
    real[place] = True
    e, real = e.reshape(total, BLOCK, size), real.reshape(total, BLOCK)
    move, begin = np.exp(step), np.exp(start)
    opens = np.zeros(total, bool)
    opens[first] = True

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / x.sum(axis=-1, keepdims=True)

    product = np.broadcast_to(np.eye(size), (total, size, size)).copy()
    for t in range(BLOCK):
        after = product @ move if t else np.where(opens[:, None, None], np.broadcast_to(begin, (size, size)), product @ move)
        after = after * e[:, t, None, :]
        product = np.where(real[:, t, None, None], after / after.sum(axis=(1, 2), keepdims=True), product)
    into = np.full((total, size), 1 / size)
    out = np.ones((total, size))
    most = int(blocks.max())
    for k in range(1, most):
        at = first[blocks > k] + k
        into[at] = scaled(np.einsum("bi,bij->bj", into[at - 1], product[at - 1]))
    for k in range(most - 1, 0, -1):
        at = first[blocks > k] + k
        out[at - 1] = scaled(np.einsum("bij,bj->bi", product[at], out[at]))
    ahead = np.empty_like(e)
    v = into
    for t in range(BLOCK):
        after = v @ move if t else np.where(opens[:, None], begin, v @ move)
        v = np.where(real[:, t, None], scaled(after * e[:, t]), v)
        ahead[:, t] = v
    v = out
    for t in range(BLOCK - 1, -1, -1):
        ahead[:, t] *= v
        if t:
            v = np.where(real[:, t, None], scaled((v * e[:, t]) @ move.T), v)
    return scaled(ahead.reshape(total * BLOCK, size)[place])


def fit(rows: list[tuple[str, str]], words_per_lexicon: int = 200, length: int = 40, sequences: int = 192, rounds: int = 120, switch: float = 0.08, rate: float = 0.4, seed: int = 42) -> Model | None:
    """A model from (lang, text) rows; None if there is no row with words. The rows are a bounded sample."""
    texts: dict[str, list[list[str]]] = {}
    for lang, text in sorted(rows):
        if w := [s for s in map(letters, words_of(text.encode())) if s]:
            texts.setdefault(lang, []).append(w)
    if not texts:
        return None
    langs, random = sorted(texts), np.random.default_rng(seed)
    lexicon: dict[str, list[int]] = {}
    for k, lang in enumerate(langs):
        common = Counter(chain.from_iterable(texts[lang])).most_common()
        for w, _ in sorted(common, key=lambda x: (-x[1], x[0]))[:words_per_lexicon]:
            lexicon.setdefault(w, []).append(k)
    size = len(langs)
    seen, familiar = familiarity([t for lang in langs for t in texts[lang]])
    model = Model(langs, np.zeros((HASHED + size, size)), np.zeros((size, size)), np.zeros(size), lexicon, seen, familiar)
    squares = [np.full_like(x, 1e-2) for x in (model.weight, model.step, model.start)]
    for _ in range(rounds):
        words, labels = [], []
        for _ in range(sequences):
            left = length
            while left:
                k = int(random.integers(size))
                text = texts[langs[k]][int(random.integers(len(texts[langs[k]])))]
                take = min(left, int(random.geometric(switch)), len(text))
                at = int(random.integers(len(text) - take + 1))
                words += text[at : at + take]
                labels += [k] * take
                left -= take
        kinds = list(dict.fromkeys(words))
        number = {w: i for i, w in enumerate(kinds)}
        at, y = np.array([number[w] for w in words]), np.array(labels)
        f, w = model.all_features(kinds)
        scores = np.stack([np.bincount(w, model.weight[f, k], len(kinds)) for k in range(size)], axis=1)[at]
        counts = np.full(sequences, length)
        p = marginals(counts, scores, model.step, model.start)
        error = p.copy()
        error[np.arange(len(y)), y] -= 1
        by_kind = np.stack([np.bincount(at, error[:, k], len(kinds)) for k in range(size)], axis=1)
        grad = np.stack([np.bincount(f, by_kind[w, k], len(model.weight)) for k in range(size)], axis=1)
        pairs = _pair_sums(scores.reshape(sequences, length, size), p.reshape(sequences, length, size), model.step)
        seen = np.zeros((size, size))
        yy = y.reshape(sequences, length)
        np.add.at(seen, (yy[:, :-1].ravel(), yy[:, 1:].ravel()), 1)
        begun = p.reshape(sequences, length, size)[:, 0].sum(axis=0) - np.bincount(yy[:, 0], minlength=size)
        for x, g, s in zip((model.weight, model.step, model.start), (grad / sequences, (pairs - seen) / sequences, begun / sequences), squares):
            s += g * g
            x -= rate * g / np.sqrt(s)
    return model


def familiarity(texts: list[list[str]]) -> tuple[np.ndarray, float]:
    """(the features that the texts have, the least share of them that a text of a learned language should have).

    Features of half of the texts are looked for in the others, whose lowest hundredth is what known languages reach; text
    unlike them reaches the share of features that are seen at all. The bound is halfway between, so it does not depend on
    how many languages there are.
    """
    def has(some: list[list[str]]) -> np.ndarray:
        found = np.zeros(HASHED, bool)
        if some:
            found[features(list({w for t in some for w in t}))[0]] = True
        return found

    half, rest = has(texts[::2]), texts[1::2] or texts
    shares = [half[features(t)[0]].mean() for t in rest]
    seen = has(texts)
    return seen, float(np.quantile(shares, 0.01) + seen.mean()) / 2


def _pair_sums(scores: np.ndarray, p: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Expected counts of neighbouring labels. A chain's pair probability is the first's marginal times the step to the second given it."""
    size = scores.shape[2]
    move = np.exp(step)
    later = np.ones((len(scores), size))
    sums = np.zeros((size, size))
    for t in range(scores.shape[1] - 1, 0, -1):
        e = np.exp(scores[:, t] - scores[:, t].max(axis=1, keepdims=True)) * later
        given = move[None] * e[:, None, :]
        norm = given.sum(axis=2)
        sums += (p[:, t - 1, :, None] * given / norm[:, :, None]).sum(axis=0)
        later = norm / norm.sum(axis=1, keepdims=True)
    return sums


def sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_lang: int, chars_per_doc: int, langs: int) -> list[tuple[str, str]]:
    """About docs_per_lang rows of each of the `langs` most frequent languages, chosen by a hash of id and text, of each a passage of chars_per_doc characters."""
    labelled = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(langs).collect()}
    if not counts:
        return []
    h = F.xxhash64(F.col(id_col), F.col(text_col))
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, int(min(1.0, docs_per_lang / n) * (1 << 20))).otherwise(share)
    last = F.greatest(F.length(text_col) - chars_per_doc, F.lit(0)) + 1
    passage = F.substring(F.col(text_col), (F.pmod(h, last) + 1).cast("int"), F.lit(chars_per_doc))
    rows = labelled.where(F.pmod(h, F.lit(1 << 20)) < share).select(F.col(lang_col).alias("lang"), passage.alias("passage"), h.alias("h"))
    # Repeated rows share a hash and may come all or none: the bound holds for them too, and the order makes it the same rows each time.
    return [(r.lang, r.passage) for r in rows.orderBy("h", "lang", "passage").limit(2 * docs_per_lang * len(counts)).collect()]


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 400, chars_per_doc: int = 3000, langs: int = 200) -> Model | None:
    """A model from a bounded sample of labelled rows, of the `langs` most frequent labels; null labels and texts are left out."""
    return fit(sample(labelled, id_col, text_col, lang_col, docs_per_lang, chars_per_doc, langs))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", runs: bool = True) -> DataFrame:
    """(id_col, lang_pred, score, n_words[, runs]) of every row, from its whole text alone.

    A word is a run of ASCII letters and characters past ASCII that holds a letter. lang_pred has the largest mean
    probability, score; equal means go to the first language in sorted order. runs are (lang, first, last) of word numbers
    with one likeliest language. Null texts and texts with no letter get `und`, score 0 and no runs, as do all rows where
    there is no model. Whole texts are read, in blocks of words. Repeated rows get a row each; other columns are not read;
    an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(id_col, text_col)
    kind = "array<struct<lang: string, first: int, last: int>>"
    extra: list[Column] = [F.array().cast(kind).alias("runs")] if runs else []
    schema = docs.select(id_col, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_words"), *extra).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for begin, texts in slices(batch.column(1), 1 << 20):
                ids = batch.column(0).slice(begin, len(texts))
                found = _predict(own, texts, runs) if own else [[UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts), [[]] * len(texts)]
                types = (pa.string(), pa.float64(), pa.int64(), pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("last", pa.int32())])))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, t) for x, t in zip(found[: 3 + runs], types)]], names=schema.names)

    return docs.mapInArrow(run, schema)


def _predict(model: Model, texts: list[bytes | None], runs: bool) -> list[list]:
    """Columns of identify() for texts, and last the mean share of their words' features that the sample has."""
    counts, scores = model.score_words([words_of(t) for t in texts])
    p = marginals(counts, scores[:, :-1], model.step, model.start)
    text = np.repeat(np.arange(len(texts)), counts)
    mean = np.stack([np.bincount(text, p[:, k], len(texts)) for k in range(len(model.langs))], axis=1) / np.maximum(counts, 1)[:, None]
    best = mean.argmax(axis=1)
    names = [model.langs[k] if n else UNKNOWN for k, n in zip(best.tolist(), counts.tolist())]
    score = np.where(counts > 0, np.minimum(mean.max(axis=1), 1.0), 0.0)
    found: list[list] = [names, score.tolist(), counts.tolist()]
    share = np.bincount(text, scores[:, -1], len(texts)) / np.maximum(counts, 1)
    if runs:
        label = p.argmax(axis=1)
        cuts = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (text[1:] != text[:-1])])) if len(label) else np.zeros(0, np.int64)
        ends = np.concatenate([cuts[1:], [len(label)]]) if len(cuts) else cuts
        base = np.cumsum(counts) - counts
        lists: list[list] = [[] for _ in texts]
        for k, d, a, b in zip(label[cuts].tolist(), text[cuts].tolist(), (cuts - base[text[cuts]]).tolist(), (ends - 1 - base[text[cuts]]).tolist()):
            lists[d].append({"lang": model.langs[k], "first": a, "last": b})
        found.append(lists)
    return [*found, share.tolist()]


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning: the CRC-32 of its id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs without texts that have no letter or are unlike all learned languages; the columns as they were, whatever their names.

    A text is unlike them if fewer of its words' n-grams and affixes than the model's bound occur in the sample: text in
    another script, or in a language of other letter sequences. Each row is decided by its own text. Without a model no
    text is identified, and none stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def test() -> Callable[[list[bytes | None]], list[bool]]:
        own = shared.value

        def passes(texts: list[bytes | None]) -> list[bool]:
            if not own:
                return [False] * len(texts)
            names, *_, share = _predict(own, texts, False)
            return [n != UNKNOWN and x >= own.familiar for n, x in zip(names, share)]

        return passes

    return filter_texts(docs, text_col, test, 1 << 20)
