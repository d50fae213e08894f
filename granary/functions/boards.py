"""Board sentences "board side hand ply" as column expressions: validity with the pieces' inventory, sparse features, material."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds in order, promoted ones after the king; letters that stand for promoted pieces; pieces of a set; values.
KINDS = "PLNSGBRK"
PROMOTED = {"+P": "T", "+L": "M", "+N": "H", "+S": "E", "+B": "C", "+R": "A"}
ORDER = KINDS + "".join(PROMOTED.values())
SET = {"P": 18, "L": 4, "N": 4, "S": 4, "G": 4, "B": 2, "R": 2}
VALUES = (100, 430, 470, 640, 680, 890, 1040, 0, 600, 600, 600, 640, 1150, 1300)
#: The index of the first hand feature, features of a hand, and where each kind's begin.
HAND_START, HAND_SIZE, HAND_OFFSETS = 2268, 38, (0, 18, 22, 26, 30, 34, 36)
#: The code of the first of the digits that stand for a kind and a side; that of an empty square is below it.
ZERO = ord("0")


def _part(sentence: Column, k: int) -> Column:
    return F.get(F.split(sentence, r"\s+"), F.lit(k))


def squares(board: Column) -> Column:
    """The board as one letter a square, rank after rank: a dot for an empty square, a letter of its own for a promoted piece."""
    for pair, letter in PROMOTED.items():
        board = F.replace(F.replace(board, F.lit(pair), F.lit(letter)), F.lit(pair.lower()), F.lit(letter.lower()))
    for n in range(1, 10):
        board = F.replace(board, F.lit(str(n)), F.lit("." * n))
    return F.replace(board, F.lit("/"), F.lit(""))


def in_hand(hand: Column, letter: str) -> Column:
    """How many pieces of a letter a hand text has: a letter alone is one."""
    n = F.regexp_extract(hand, f"([0-9]*){letter}", 1)
    return F.when(~F.contains(hand, F.lit(letter)), 0).when(n == "", 1).otherwise(n.try_cast("int"))


def sentence_valid(sentence: Column) -> Column:
    """Shape and inventory, not the rules of play (FN-14): nine ranks of nine squares, side b or w, a ply of 1 or more, a hand
    that names each piece once, a king each, and no more of a kind, promoted and in hands included, than a set has."""
    board, side, hand, ply = (_part(sentence, k) for k in range(4))
    ranks = F.split(board, "/")
    shape = (F.size(F.split(sentence, r"\s+")) == 4) & (F.size(ranks) == 9) & F.forall(ranks, lambda r: r.rlike(r"^([1-9]|[PLNSGBRKplnsgbrk]|\+[PLNSBRplnsbr])+$") & (F.length(squares(r)) == 9))
    rest = side.isin("b", "w") & ply.rlike("^[0-9]*[1-9][0-9]*$") & hand.rlike("^(-|(([1-9][0-9]*)?[PLNSGBRplnsgbr])+)$")
    once = F.lit(True)
    fits = (F.regexp_count(board, F.lit("K")) == 1) & (F.regexp_count(board, F.lit("k")) == 1)
    for letter, most in SET.items():
        for c in (letter, letter.lower()):
            once = once & (F.regexp_count(hand, F.lit(c)) <= 1)
        fits = fits & (F.regexp_count(board, F.lit(f"[{letter}{letter.lower()}]")) + in_hand(hand, letter) + in_hand(hand, letter.lower()) <= most)
    return F.coalesce(shape & rest & once & fits, F.lit(False))


def active_features(sentence: Column, perspective: int) -> Column:
    """Indices of the features that a valid position sets, seen by side 0 or 1: pieces by square (file by file), then hands (FN-15).

    The board is made once a row and its letters become one digit each, so that what is done for every square is a look-up.
    """
    flat, hand = squares(_part(sentence, 0)), _part(sentence, 2)
    own, other = (ORDER, ORDER.lower()) if perspective == 0 else (ORDER.lower(), ORDER)
    digits = F.translate(flat, own + other, "".join(chr(ZERO + 2 * k + side) for side in (0, 1) for k in range(len(ORDER))))
    places = F.lit([(at % 9 * 9 + at // 9) * 28 - ZERO for at in range(81)])  # the board goes rank by rank
    pieces = F.transform(F.split(digits, ""), lambda c, at: F.when(F.ascii(c) >= ZERO, F.get(places, at) + F.ascii(c)))
    on_board = F.coalesce(F.sort_array(F.array_compact(pieces)), F.array().cast("array<int>"))
    held = []
    for colour in (0, 1):
        for letter, start in zip(SET, HAND_OFFSETS):
            n = in_hand(hand, letter.lower() if colour else letter)
            first = HAND_START + (colour * 2 + perspective) * HAND_SIZE + start
            held.append(F.when(n > 0, F.sequence(F.lit(first), F.lit(first - 1) + n)).otherwise(F.array().cast("array<int>")))
    return F.concat(on_board, *held)


def material(sentence: Column) -> Column:
    """The value of a valid position's pieces, hands included, for the side to move less the other's (FN-16)."""
    flat, side, hand = squares(_part(sentence, 0)), _part(sentence, 1), _part(sentence, 2)
    total = F.lit(0)
    for k, letter in enumerate(ORDER):
        total = total + VALUES[k] * (F.regexp_count(flat, F.lit(letter)) - F.regexp_count(flat, F.lit(letter.lower())))
        if letter in SET:
            total = total + VALUES[k] * (in_hand(hand, letter) - in_hand(hand, letter.lower()))
    return F.when(side == "b", total).otherwise(-total).cast("long")


def turned(sentence: Column) -> Column:
    """The same position seen from the other side (FN-26): the board turned by half, sides swapped on it, in the hands and to move; the ply stays.

    Hands come out in the usual order, so a second turn gives a valid sentence back in that order.
    """
    flat = F.translate(F.reverse(squares(_part(sentence, 0))), ORDER + ORDER.lower(), ORDER.lower() + ORDER)
    board = F.concat_ws("/", *[F.substring(flat, 1 + 9 * k, 9) for k in range(9)])
    for n in range(9, 0, -1):
        board = F.replace(board, F.lit("." * n), F.lit(str(n)))
    for pair, letter in PROMOTED.items():
        board = F.replace(F.replace(board, F.lit(letter), F.lit(pair)), F.lit(letter.lower()), F.lit(pair.lower()))

    def held(letter: str, other: str) -> Column:
        n = in_hand(_part(sentence, 2), other)
        return F.when(n == 0, "").when(n == 1, letter).otherwise(F.concat(n.cast("string"), F.lit(letter)))

    order = "RBGSNLP"
    hand = F.concat(*[held(c, c.lower()) for c in order], *[held(c.lower(), c) for c in order])
    side = F.when(_part(sentence, 1) == "b", "w").otherwise("b")
    return F.concat_ws(" ", board, side, F.when(hand == "", "-").otherwise(hand), _part(sentence, 3))
