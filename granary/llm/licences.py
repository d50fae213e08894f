"""Operator 6, licence scans. DataFrame functions only, and no shuffle of text: each document is scored where it is read.

A paragraph is a block of lines without a blank one between them; in a block of several lines each line is also looked at
alone, as notices often stand in one line. A paragraph's word n-grams (one to three words) are scored by sparse logistic
regression over licence families and an unknown class, whose temperature is calibrated on notices that the fit did not
see. A family is confirmed if the paragraph also holds enough of the n-grams of one of the family's templates, and all of
the template's n-grams with a number in them: so version 2 never confirms version 3.

The classifier is sparse, so most n-grams weigh nothing. Each n-gram that weighs holds a key word (KEY of the model), so
only the n-grams around key words are made; nothing that weighs is missed. Weights are looked up in a literal table of
buckets by a hash of the n-gram, and the n-gram itself is compared.

The classifier is fitted from the fixed notices of licence_notices, a few thousand rows; the weights are MAX_WEIGHTS rows at
most, which bounds what is sent to the tasks.
"""

from __future__ import annotations

import json
import re
import textwrap
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licence_notices import FAMILIES, NOT_ALONE, OTHER_LICENCES, OTHERS, STOP, WORDINGS

MAX_WEIGHTS = 20_000
#: Buckets of the table of weights.
BUCKETS = 4096
UNKNOWN = "unknown"
#: A word: ASCII letters and digits, with full stops inside.
WORD = r"[A-Za-z0-9]+(?:\.+[A-Za-z0-9]+)*"


def plain_words(text: str) -> list[str]:
    return [w.lower() for w in re.findall(WORD, text)]


def plain_ngrams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def generic(word: str) -> bool:
    """Whether a word alone says nothing: a function word or a number."""
    return word in STOP or not re.search("[a-z]", word)


def telling(gram: str) -> bool:
    """Whether an n-gram may be a feature: not function words and numbers alone, nor a single word that is short or a word of a language."""
    words = gram.split(" ")
    return not all(map(generic, words)) and (len(words) > 1 or len(gram) > 2 and gram not in NOT_ALONE)


def notices() -> list[tuple[str, str, str]]:
    """(text, label, source) of distinct notices; notices of one source, a name or a paragraph, are of one label."""
    made = []
    for family, (names, paragraphs) in FAMILIES.items():
        made += [(w.format(n), family, n) for n in names for w in WORDINGS if w != "{}" or n.lower() not in NOT_ALONE]
        for p in paragraphs:
            parts = [p, *re.split(r"(?<=[.;:]) ", p), *[x for width in (45, 60, 78) for x in textwrap.wrap(p, width)]]
            made += [(x, family, p) for x in parts if len(x.split()) > 4]
    made += [(w.format(n), UNKNOWN, n) for n in OTHER_LICENCES for w in WORDINGS]
    made += [(x, UNKNOWN, x) for x in OTHERS]
    return list({x[0]: x for x in made}.values())


@dataclass
class Model:
    classes: list[str]  # the unknown class is the last
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float
    keys: list[str]
    templates: dict[str, list[list[str]]]  # n-grams of each


def _grouped(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def _descend(rows: list[list[int]], y: np.ndarray, features: int, classes: int, sparsity: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, biases) by accelerated proximal gradient steps on the mean logistic loss with an L1 penalty."""
    rows = [[*r, features] for r in rows]  # the last feature is the bias
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.concatenate(rows)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    order = np.argsort(feature, kind="stable")
    held, first_of = np.unique(feature[order], return_index=True)
    onehot = np.eye(classes)[y]
    v = np.ones(features + 1) / np.sqrt(features + 1)  # the largest eigenvalue of X'X / n bounds the curvature
    for _ in range(30):
        u = _grouped(v[feature], first)
        x = np.zeros(features + 1)
        x[held] = _grouped(u[at[order]], first_of)
        size = np.linalg.norm(x)
        v = x / size
    rate = 2 * len(rows) / size
    w = np.zeros((features + 1, classes))
    ahead, t = w, 1.0
    for _ in range(steps):
        z = _grouped(ahead[feature], first)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        error = e / e.sum(axis=1, keepdims=True) - onehot
        g = np.zeros_like(w)
        g[held] = _grouped(error[at[order]], first_of) / len(rows)
        new = ahead - rate * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * sparsity, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / after * (new - w), new, after
    return w[:-1], w[-1]


@cache
def train(sparsity: float = 2e-4, steps: int = 150) -> Model:
    """The model. Every fifth source calibrates the temperature of a fit that sees only the others; the weights are of all."""
    made = notices()
    grams = [sorted(plain_ngrams(plain_words(t))) for t, _, _ in made]
    found = Counter(g for row in grams for g in row if telling(g))
    known = {g: i for i, g in enumerate(sorted(g for g, n in found.items() if n > 1))}
    if len(known) > MAX_WEIGHTS:
        raise ValueError(f"{len(known)} features; MAX_WEIGHTS is {MAX_WEIGHTS}")
    classes = [*FAMILIES, UNKNOWN]
    rows = [[known[g] for g in row if g in known] for row in grams]
    y = np.array([classes.index(label) for _, label, _ in made])
    source = {s: i for i, s in enumerate(dict.fromkeys(s for _, _, s in made))}
    held = np.array([source[s] % 5 == 3 for _, _, s in made])
    w, b = _descend([r for r, h in zip(rows, held) if not h], y[~held], len(known), len(classes), sparsity, steps)
    z = np.stack([w[r].sum(axis=0) + b for r, h in zip(rows, held) if h])
    right = np.arange(len(z)), y[held]
    loss = {t: (np.log(np.exp((z - z.max(axis=1, keepdims=True)) / t).sum(axis=1)) - ((z - z.max(axis=1, keepdims=True)) / t)[right]).mean() for t in np.arange(0.4, 3.01, 0.1).round(1).tolist()}
    w, b = _descend(rows, y, len(known), len(classes), sparsity, steps)
    weights = {g: w[i].round(6).tolist() for g, i in known.items() if np.abs(w[i]).max() >= 1e-3}
    return Model(classes, weights, b.round(6).tolist(), min(loss, key=loss.get), _key_words(weights), templates())


def templates() -> dict[str, list[list[str]]]:
    """The n-grams of each family's names and paragraphs; a name that says nothing alone stands in wordings."""
    found = {}
    for family, (names, paragraphs) in FAMILIES.items():
        alone = [n for n in names if n.lower() not in NOT_ALONE]
        worded = [w.format(n) for n in names if n.lower() in NOT_ALONE for w in WORDINGS if w != "{}"]
        found[family] = [sorted(plain_ngrams(plain_words(x))) for x in [*alone, *worded, *paragraphs]]
    return found


def _key_words(weights: dict[str, list[float]]) -> list[str]:
    """Words of which each n-gram that weighs holds one: those of single words, then the most useful of the rest."""
    keys = {g for g in weights if " " not in g}
    left = [words for g in weights if " " in g and not keys & set(words := [w for w in g.split(" ") if not generic(w)])]
    while left:
        counts = Counter(w for words in left for w in set(words))
        best = max(counts, key=lambda w: (counts[w], w))
        keys.add(best)
        left = [words for words in left if best not in words]
    return sorted(keys)


def split_words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def _ngram(words: Column, start: Column, n: int) -> Column:
    return F.when((start >= 0) & (start + n <= F.size(words)), F.array_join(F.slice(words, start + 1, n), " "))


def ngrams(words: Column) -> Column:
    """Distinct n-grams of one to three words."""
    of = lambda n: F.transform(words, lambda _, i: _ngram(words, i, n))
    return F.array_distinct(F.filter(F.concat(of(1), of(2), of(3)), lambda g: g.isNotNull()))


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _json(rows: list, schema: str) -> Column:
    """A fixed nested value as a literal."""
    return F.from_json(F.lit(json.dumps(rows)), schema)


class Scorer:
    """The model as column expressions."""

    def __init__(self, model: Model):
        self.model = model
        self.table = model.weights

    def with_literals(self, rows: DataFrame) -> DataFrame:
        """rows with the columns `buckets` and `templates`, which are constants."""
        buckets: list[list[dict]] = [[] for _ in range(BUCKETS)]
        names = list(self.model.weights)
        spark = rows.sparkSession
        hashes = spark.range(1).select(F.from_json(F.lit(json.dumps(names)), "array<string>").alias("g")).select(F.transform("g", lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)))).first()[0]
        for g, b in zip(names, hashes):
            buckets[b].append({"g": g, "w": self.model.weights[g]})
        templates = [{"family": f, "all": [{"grams": g, "numbers": [x for x in g if re.search("[0-9]", x)]} for g in t]} for f, t in self.model.templates.items()]
        return rows.withColumns({"buckets": _json(buckets, "array<array<struct<g: string, w: array<double>>>>"), "templates": _json(templates, "array<struct<family: string, all: array<struct<grams: array<string>, numbers: array<string>>>>>")})

    def has_key(self, words: Column) -> Column:
        return F.exists(words, lambda w: w.isin(self.model.keys))

    def weighing(self, words: Column) -> Column:
        """Distinct n-grams around key words."""
        at = F.filter(F.transform(words, lambda w, i: F.when(w.isin(self.model.keys), i)), lambda i: i.isNotNull())
        around = F.flatten(F.transform(at, lambda i: F.array(*[_ngram(words, i - back, n) for n in (1, 2, 3) for back in range(n)])))
        return F.array_distinct(F.filter(around, lambda g: g.isNotNull()))

    def logits(self, grams: Column) -> Column:
        def add(z: Column, g: Column) -> Column:
            bucket = F.filter(F.get("buckets", F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int")), lambda b: b["g"] == g)
            return F.when(F.size(bucket) > 0, F.zip_with(z, bucket[0]["w"], lambda a, b: a + b)).otherwise(z)

        z = F.aggregate(grams, F.array(*map(F.lit, self.model.bias)), add)
        return F.transform(z, lambda x: F.round(x, 6) / self.model.temperature)

    def prediction(self, words: Column) -> Column:
        """(family, probability) of the likeliest class, the first on ties."""

        def of(z: Column) -> Column:
            share = 1 / F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(z)))
            return F.struct(F.element_at(F.array(*map(F.lit, self.model.classes)), F.array_position(z, F.array_max(z)).cast("int")).alias("family"), F.round(share, 6).alias("probability"))

        return _let(self.logits(self.weighing(words)), of)

    def template_share(self, words: Column, family: Column) -> Column:
        """The largest share of a template's n-grams that the words hold, of the family's templates whose numbers they all hold."""
        templates = F.filter("templates", lambda t: t["family"] == family)[0]["all"]

        def best(grams: Column) -> Column:
            part = lambda t: F.when(F.size(F.array_except(t["numbers"], grams)) == 0, F.size(F.array_intersect(t["grams"], grams)) / F.size(t["grams"])).otherwise(0.0)
            return F.round(F.coalesce(F.array_max(F.transform(templates, part)), F.lit(0.0)), 6)

        return _let(ngrams(words), best)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, similar: float = 0.8) -> DataFrame:
    """One row per licence paragraph: id_col, paragraph and last_line (its first and last line number), family, probability, template_share, confirmed.

    A line, alone in its block or not, is listed if its likeliest class is a family with a probability of `least` or more.
    It is confirmed if at least `similar` of the n-grams of one of that family's templates are in it. A block of several
    lines is listed if it is confirmed and none of its lines is confirmed for the same family; the block's lines are then
    listed only if they are confirmed. Equal classes go to the first in the order of FAMILIES. Null and empty texts have no
    rows, and neither have texts without notices. Equal paragraphs of a document get a row each; repeated rows (same id and
    text) count once. Null ids are kept. Whole texts are scanned; a very long one is one row. An empty table gives an empty result.
    """
    scorer = Scorer(train())
    blank = lambda x: F.btrim(x, F.lit(" \t\r\f\x0b")) == ""
    lines = F.transform(F.split(F.col(text_col), "\n"), lambda x: F.struct(blank(x).alias("blank"), split_words(x).alias("words")))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.xxhash64(F.lit(1), text_col).alias("g"), lines.alias("lines"))
    edge = lambda step: F.filter(  # noqa: E731  lines that are not blank, next to a blank one or the text's end
        F.transform("lines", lambda x, i: F.when(~x["blank"] & F.coalesce(F.when(i + step >= 0, F.get("lines", i + step)["blank"]), F.lit(True)), i)), lambda i: i.isNotNull()
    )
    rows = rows.withColumns({"firsts": edge(-1), "lasts": edge(1)})
    single = F.transform("lines", lambda x, i: F.struct(i.alias("first"), i.alias("last"), x["words"].alias("words")))
    blocks = F.filter(F.zip_with("firsts", "lasts", lambda a, b: F.struct(a.alias("first"), b.alias("last"))), lambda b: b["last"] > b["first"])
    blocks = F.transform(blocks, lambda b: F.struct(b["first"].alias("first"), b["last"].alias("last"), F.flatten(F.transform(F.slice("lines", b["first"] + 1, b["last"] - b["first"] + 1), lambda x: x["words"])).alias("words")))
    rows = rows.select("id", "h", "g", F.filter(F.concat(single, blocks), lambda u: scorer.has_key(u["words"])).alias("units"))
    rows = scorer.with_literals(rows)
    rows = rows.withColumn("units", F.transform("units", lambda u: F.struct(u["first"], u["last"], u["words"], scorer.prediction(u["words"]).alias("p"))))
    rows = rows.withColumn("units", F.filter("units", lambda u: (u["p"]["family"] != UNKNOWN) & (u["p"]["probability"] >= least)))
    share = lambda u: scorer.template_share(u["words"], u["p"]["family"])
    rows = rows.withColumn("units", F.transform("units", lambda u: F.struct(u["first"].alias("first"), u["last"].alias("last"), u["p"]["family"].alias("family"), u["p"]["probability"].alias("probability"), share(u).alias("share"))))
    inside = lambda x, b: (x["first"] >= b["first"]) & (x["last"] <= b["last"])
    sure = F.filter("units", lambda u: u["share"] >= similar)
    rows = rows.withColumns({"sure_lines": F.filter(sure, lambda u: u["first"] == u["last"]), "sure_blocks": F.filter(sure, lambda u: u["first"] < u["last"])})
    rows = rows.withColumn("sure_blocks", F.filter("sure_blocks", lambda b: ~F.exists("sure_lines", lambda x: inside(x, b) & (x["family"] == b["family"]))))
    unsure = F.filter("units", lambda u: (u["first"] == u["last"]) & (u["share"] < similar) & ~F.exists("sure_blocks", lambda b: inside(u, b)))
    # The outer form, as filters before an inner one would be pushed down into the lambdas that make the lines, once for each line.
    found = rows.select("id", "h", "g", F.explode_outer(F.concat("sure_lines", "sure_blocks", unsure)).alias("u")).where("u IS NOT NULL").dropDuplicates()
    return found.select(F.col("id").alias(id_col), F.col("u.first").alias("paragraph"), F.col("u.last").alias("last_line"), "u.family", "u.probability", F.col("u.share").alias("template_share"), (F.col("u.share") >= similar).alias("confirmed"))
