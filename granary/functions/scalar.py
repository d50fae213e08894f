"""Scalar functions as column expressions; all run inside generated code, none in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_unit(*parts: Column | str) -> Column:
    """The first 64 bits of the SHA-256 of the colon-joined parts, as an exact decimal (FN-01, FN-02)."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_split(seed: str, identity: Column, folds: int = 10) -> Column:
    """Leakage-safe split: equal identities share a split whatever the order or the number of files (FN-02)."""
    return F.when(hash_unit(F.lit(seed), identity.cast("string")) % folds == 0, "holdout").otherwise("train")


def seeded_rank(seed: str, *parts: Column) -> Column:
    """A reproducible pseudo-random rank; sorting by it is a seeded shuffle (TOP-01)."""
    return F.sha2(F.concat_ws("\u0000", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def user_key(identity: Column) -> Column:
    """The SHA-256 of an id in folded case (FN-28): upper and lower case in turn, and the sharp s, which Spark leaves, as ss."""
    return F.sha2(F.replace(F.lower(F.upper(identity.cast("string"))), F.lit("ß"), F.lit("ss")), 256)


def position_key(text: Column, fields: int = 3) -> Column:
    """The first fields of a text with white space collapsed (FLT-01)."""
    return F.substring_index(F.trim(F.regexp_replace(text, r"\s+", " ")), " ", fields)


def inclusive_limit(n: Column) -> Column:
    """N + N div 100 for positive N, else null (FN-05)."""
    return F.when(n > 0, n + F.floor(n / 100).cast("long"))


def flip_score(score: Column, first_side: Column) -> Column:
    return F.when(first_side, score).otherwise(-score)


def flip_bound(bound: Column, first_side: Column) -> Column:
    """Lower and upper change places when the side changes (FN-06)."""
    return F.when(first_side, bound).when(bound == "lower", "upper").when(bound == "upper", "lower").otherwise(bound)


def blend_half_even(a: Column, b: Column) -> Column:
    """(a + b) / 2 of integers, halves to the even neighbour (FN-07)."""
    total = a + b
    half = F.floor(total / 2).cast("long")
    return F.when(F.pmod(total, F.lit(2)) == 0, half).otherwise(half + F.pmod(half, F.lit(2)))


def even_integer(v: Column) -> Column:
    """The nearest even integer, 2 * round-half-even(v / 2) (FN-08)."""
    return (2 * F.bround(v / 2)).cast("long")


def quantise(v: Column, scale: int = 64, limit: int = 32767, nearest: bool = True) -> Column:
    """Scaled, clamped and rounded half to even, or cut towards zero (FN-09)."""
    x = F.greatest(F.least(v * scale, F.lit(float(limit))), F.lit(-float(limit)))
    return (F.bround(x) if nearest else x).cast("int")


def mate_winner(token: Column) -> Column:
    """Who wins by a lexical mate token: its sign counts, even in -0 and in a bare sign (FN-13)."""
    return F.when(token.rlike(r"^[+]?\d+$|^[+]$"), "self").when(token.rlike(r"^-\d*$"), "other")


def mate_distance(token: Column) -> Column:
    """The distance of a mate token, null for a bare sign."""
    return F.abs(F.try_to_number(F.nullif(F.regexp_replace(token, "[+-]", ""), F.lit("")), F.lit("999999")).cast("int"))


def learning_rate(step: Column, base: float, warm: int, total: int, kind: str = "cosine", half_every: int = 100) -> Column:
    """Constant, step-half or cosine schedule after a linear warm-up (FN-21)."""
    rate = {
        "constant": F.lit(base),
        "step": base * F.pow(F.lit(0.5), F.floor(step / half_every)),
        "cosine": base * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * F.least(F.greatest(step - warm, F.lit(0)) / (total - warm), F.lit(1.0)))),
    }[kind]
    return F.when(step < warm, base * (step + 1) / warm).otherwise(rate)


def pairwise_logistic(margin: Column) -> Column:
    """log(1 + exp(-m)) without overflow (FN-24)."""
    return F.log1p(F.exp(-F.abs(margin))) + F.greatest(-margin, F.lit(0.0))


def weight_of(weights: Column, key: Column, default: float = 1.0) -> Column:
    """A weight from a k=v,k=v text, or the default; a key given twice is an error (FN-25, JON-12)."""
    return F.coalesce(F.element_at(F.str_to_map(weights, F.lit(","), F.lit("=")), key).cast("double"), F.lit(default))


def forbidden(text: Column) -> Column:
    """Whether a text has an absolute path, a private address or a long hexadecimal id (FN-18, FLT-20)."""
    return text.rlike(r"(?:^|\s)/(?:home|root|mnt|Users)/|\b192\.168\.|\b[0-9a-f]{64}\b")


def canonical_json(*columns: Column | str) -> Column:
    """JSON of the columns in the order given, nulls kept (SNK-03); canonical JSON has them sorted by name (FN-20)."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def board_valid(board: Column, ranks: int = 9, files: int = 9) -> Column:
    """Whether a board text has `ranks` parts of `files` squares; digits are runs of empty squares, + marks the next piece (whole sentences: boards.sentence_valid)."""
    squares = lambda part: F.length(F.regexp_replace(part, "[+0-9]", "")) + F.aggregate(F.regexp_extract_all(part, F.lit("[0-9]"), F.lit(0)), F.lit(0), lambda n, d: n + d.cast("int"))
    parts = F.split(board, "/")
    return (F.size(parts) == ranks) & F.forall(parts, lambda p: (squares(p) == files) & p.rlike(r"^(?:[1-9]|\+?[A-Za-z])+$"))


def signed_material(board: Column, values: dict[str, int]) -> Column:
    """Values of upper-case pieces less those of lower-case ones; a promoted piece is given as +x (FN-16; with hands: boards.material).

    The count of a plain piece includes promoted ones unless `values` has +x, which then counts apart.
    """
    total = F.lit(0)
    for piece, value in values.items():
        for name, sign in ((piece.upper(), 1), (piece.lower(), -1)):
            alone = "(?<![+])" if "+" + piece in values else ""
            total = total + sign * value * F.regexp_count(board, F.lit(alone + name.replace("+", "[+]")))
    return total.cast("long")


def rotated_swap(board: Column) -> Column:
    """A board turned by half a turn with colours swapped; + stays before its piece (FN-26)."""
    lower = "abcdefghijklmnopqrstuvwxyz"
    turned = F.reverse(F.translate(board, lower + lower.upper(), lower.upper() + lower))
    return F.regexp_replace(turned, r"([A-Za-z])[+]", "+$1")


def anonymised(game: Column) -> Column:
    """A game text with both players' names replaced (SNK-10)."""
    return F.regexp_replace(game, r"(?m)^N([+-]).*$", "N$1player")


def markdown_row(*columns: Column | str) -> Column:
    """A row of a Markdown table; nulls are empty cells and bars are escaped (SNK-06)."""
    cells = [F.replace(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
