"""Personal data: fixed patterns, and a linear-chain conditional random field for what patterns miss.

The field labels words as O, B-kind or I-kind over word-shape features of a word and its REACH neighbours on either
side. It is trained in numpy, with the exact likelihood gradient, on a small labelled table: the one given (at most
MOST_ROWS rows of it are used), or else the one that `labelled_table` generates by rule. It adds spans in forms that
the patterns don't cover: phone numbers without a plus, with slashes, dots, blanks or brackets; email addresses spelt
out with "at" and "dot", bare or in brackets; IPv6 addresses; cards of 13 to 15 digits. An added span must pass the
check of its kind and not touch a span of the patterns.

Decoding is exact Viterbi in numpy batches over the words that matter. A word is plain if it has no digit, no @, no
two colons, no bracketed "at" or "dot", and is neither a bracket nor one of some words such as "tel". After training
a certificate is computed: by it a plain word with only plain words within REACH is O in every best path, whatever
stands around. Such words cut a text into short stretches that are decoded by themselves, with the same result as
decoding whole texts. Without the certificate whole texts are decoded.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Of overlapping added spans there are
none; spans of different patterns may overlap and are all listed, by kind, then start. Texts and words of any length
are read whole. Rows are independent: repeats are read one by one, an empty table gives an empty one, and extra
columns do not matter.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import batch_of, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
SHOWN_AS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}
#: Rows of the generated table, rows of a given one that are used at most, and steps of training.
TABLE_ROWS, MOST_ROWS, STEPS, RATE = 2500, 20_000, 80, 0.2
#: Neighbours on either side that a word's features look at.
REACH = 3
#: Penalties. Moves are held small, so that words decide.
DECAY, MOVE_DECAY = 1e-4, 1e-2
#: The weight of O for a plain word with only plain words within REACH. Fixed, so that such a word is O in every best
#: path unless moves outweigh it, which is checked.
QUIET = 40.0

Span = tuple[str, int, int]

# -- patterns -----------------------------------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start where a run of digits starts: from within a run it would end alike. This keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGITS = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def pattern_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by kind, then start."""
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGITS.sub("", m[0])) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


# -- features -----------------------------------------------------------------------------------------------------

_WORD = re.compile("[^ \t\n\x0b\f\r]+")
#: What a stretch must hold for an added span to pass its check.
_MATTERS = re.compile(r"[0-9@]|:[0-9A-Fa-f]*:|\bdot\b|[(\[{<]\s*at\s*[)\]}>]", re.IGNORECASE)
_MARKED = re.compile(r"[0-9@]|:[0-9A-Fa-f]*:|[(\[{<](?:at|dot)[)\]}>]|^[()\[\]{}<>]+$", re.IGNORECASE)
_RUN_D, _RUN_X, _RUN_L = re.compile("0+"), re.compile("X+"), re.compile("x+")
#: Words that tell what a number near them is, by group.
TRIGGERS = {
    word: group
    for group, some in {
        "phone": "call phone telephone tel fax mobile mob cell ring whatsapp sms telefon ruf handy anrufen kontakt contact téléphone appelez portable llame teléfono móvil hotline dial text",
        "mail": "mail email e-mail mailto courriel correo write",
        "card": "card visa amex mastercard karte carte tarjeta credit",
        "host": "ip ipv6 ipv4 host server ping gateway router address node dns",
        "number": "order id invoice ref isbn version serial sku ticket account no nr number token password section chapter page seite rev build room year since population lot",
        "at": "at",
        "dot": "dot",
    }.items()
    for word in some.split()
}
_EDGE_LEFT, _EDGE_RIGHT = "\"'<[{", "\"'>]}.,;:!?"


def core(word: str) -> str:
    """A word without quotes, brackets and stops around it; round brackets belong to phone numbers."""
    return word.lstrip(_EDGE_LEFT).rstrip(_EDGE_RIGHT) or word


def shape(word: str) -> str:
    return "".join("0" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)


#: Longer words are looked at anew each time, so that a cache of words has a bounded size.
CACHED_CHARS = 64


def _bounded(function: Any) -> Any:
    """A function of a word that remembers its answers for short words."""
    cached = functools.lru_cache(100_000)(function)
    return lambda word: (cached if len(word) <= CACHED_CHARS else function)(word)


@_bounded
def trigger(word: str) -> str | None:
    bare = core(word).lower().strip("()[]{}<>:=.")
    return TRIGGERS.get(bare) or ("bracket" if not bare else None)


@_bounded
def plain(word: str) -> bool:
    return not _MARKED.search(word) and trigger(word) is None


@_bounded
def own_features(word: str) -> tuple[str, ...]:
    """Features of a word by itself: shape with and without run lengths, letters of a hexadecimal group, digit checks."""
    bare = core(word)
    full = _RUN_X.sub("X", _RUN_L.sub("x", shape(bare)))
    digits = _NOT_DIGITS.sub("", bare)
    found = [f"s={_RUN_D.sub(lambda m: str(len(m[0])) + 'd', full)}", f"c={_RUN_D.sub('0', full)}"]
    if group := trigger(word):
        found.append(f"w={group}")
    if digits:
        found.append(f"n={min(len(digits), 20)}")
        if bare[0] == "0":
            found.append("zero")
        if 13 <= len(digits) <= 15 and bare.isdigit():
            found.append(f"luhn={luhn(digits)}")
    if bare.count(":") >= 2 and re.fullmatch(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}", bare):
        found.append(f"hexgroups={'whole' if '::' in bare or bare.count(':') == 7 else 'part'}")
    return tuple(found)


@_bounded
def beside(word: str) -> str:
    """What a word that isn't plain is to its neighbours: its group, or its shape."""
    group = trigger(word)
    return f"w:{group}" if group else own_features(word)[0 if len(word) <= 6 else 1]


def features(words: Sequence[str], i: int) -> list[str]:
    """Plain words share one feature and tell their neighbours nothing, so a plain word among plain words always
    looks the same: quiet."""
    sides = [f"{k - i}:{beside(words[k])}" for k in range(max(0, i - REACH), min(len(words), i + REACH + 1)) if k != i and not plain(words[k])]
    if plain(words[i]):
        return ["plain", *sides] if sides else ["quiet"]
    return ["marked", *own_features(words[i]), *sides]


# -- the field ----------------------------------------------------------------------------------------------------


class Field:
    """weights: features x labels; moves: labels x labels. A text begins and ends next to O."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray) -> None:
        self.names, self.weights, self.moves = names, weights, moves
        quiet = self.scores(["a"])[0]
        turn = self.moves[:, :, None] + self.moves[None, :, :]  # a -> y -> b
        gain = (turn - turn[:, :1, :]).max(axis=(0, 2))  # what label y can win over O by its moves
        self.certified = bool((quiet[0] - quiet[1:] > gain[1:]).all())

    def scores(self, words: Sequence[str], only: Sequence[int] | None = None) -> np.ndarray:
        get = self.names.get
        out = np.zeros((len(words) if only is None else len(only), len(LABELS)))
        for row, i in enumerate(range(len(words)) if only is None else only):
            known = [k for f in features(words, i) if (k := get(f)) is not None]
            out[row] = self.weights[known].sum(axis=0)
        return out

    def decode(self, stretches: Sequence[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over many stretches at once, those of about one length together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(stretches)
        order = sorted(range(len(stretches)), key=lambda k: len(stretches[k]))
        for lo in range(0, len(order), 512):
            some = [k for k in order[lo : lo + 512] if len(stretches[k])]
            if not some:
                continue
            sizes = np.array([len(stretches[k]) for k in some])
            longest = int(sizes.max())
            emit = np.zeros((len(some), longest, len(LABELS)))
            for row, k in enumerate(some):
                emit[row, : sizes[row]] = stretches[k]
            best = self.moves[0] + emit[:, 0]
            back = np.zeros((len(some), longest, len(LABELS)), np.int8)
            ends = np.where((sizes == 1)[:, None], best + self.moves[:, 0], 0.0)
            for t in range(1, longest):
                paths = best[:, :, None] + self.moves
                back[:, t] = paths.argmax(axis=1)
                best = paths.max(axis=1) + emit[:, t]
                ends[sizes == t + 1] = (best + self.moves[:, 0])[sizes == t + 1]
            labels = ends.argmax(axis=1)
            paths_out = np.zeros((len(some), longest), np.int64)
            for t in range(longest - 1, -1, -1):
                inside = t < sizes
                paths_out[inside, t] = labels[inside]
                labels = np.where(inside, back[np.arange(len(some)), t, labels], labels)
            for row, k in enumerate(some):
                out[k] = paths_out[row, : sizes[row]]
        return out


def train(table: Sequence[tuple[list[str], list[str]]], steps: int = STEPS, rate: float = RATE, decay: float = DECAY, move_decay: float = MOVE_DECAY) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam; forward and backward sums over all rows at once."""
    names: dict[str, int] = {"quiet": 0}
    number = {label: k for k, label in enumerate(LABELS)}
    looks: dict[tuple[int, ...], int] = {}  # words often look alike: what follows is done once a look
    rows = [[looks.setdefault(tuple(names.setdefault(f, len(names)) for f in features(words, i)), len(looks)) for i in range(len(words))] for words, _ in table]
    n, longest, k = len(table), max(map(len, rows)), len(LABELS)
    sizes = np.array([len(r) for r in rows])
    word_r, word_t, look = (np.array(x) for x in zip(*[(r, t, at) for r, row in enumerate(rows) for t, at in enumerate(row)], strict=True))
    at_f = np.array([f for own in looks for f in own])
    look_start = np.cumsum([0, *map(len, looks)])[:-1]
    at_look = np.repeat(np.arange(len(looks)), list(map(len, looks)))
    by_name, by_look = np.argsort(at_f, kind="stable"), np.argsort(look, kind="stable")
    in_use, names_start = np.unique(at_f[by_name], return_index=True)
    looks_start = np.flatnonzero(np.diff(look[by_look], prepend=-1))

    def by_features(of_words: np.ndarray) -> np.ndarray:
        """Sums of a value of each word over the words that have a feature."""
        out = np.zeros((len(names), k))
        out[in_use] = np.add.reduceat(np.add.reduceat(of_words[by_look], looks_start)[at_look[by_name]], names_start)
        return out

    gold = np.zeros((n, longest), np.int64)
    for r, (_, labels) in enumerate(table):
        gold[r, : len(labels)] = [number[x] for x in labels]
    inside = np.arange(longest) < sizes[:, None]
    # every row ends with a move to O: the padding is O at no cost
    true_moves = np.zeros((k, k))
    np.add.at(true_moves, (np.concatenate([np.zeros((n, 1), np.int64), gold[:, :-1]], axis=1)[inside], gold[inside]), 1)
    np.add.at(true_moves, (gold[np.arange(n), sizes - 1], 0), 1)
    true_weights = by_features(np.eye(k)[gold[word_r, word_t]])
    theta = np.zeros((len(names) + k, k))
    penalty = np.repeat([decay, move_decay], [len(names), k])[:, None]
    quiet = names["quiet"]
    theta[quiet, 0] = QUIET
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    rows_at = np.arange(n)
    for step in range(1, steps + 1):
        weights, moves = theta[: len(names)], theta[len(names) :]
        power = np.exp(moves)
        emit = np.zeros((longest, n, k))
        emit[word_t, word_r] = np.add.reduceat(weights[at_f], look_start)[look]
        emit = np.exp(emit - emit.max(axis=2, keepdims=True))
        # sums over paths up to a word, and from it on; only their proportions within a row matter
        ahead, back = np.empty_like(emit), np.ones_like(emit)
        ahead[0] = power[0] * emit[0]
        for t in range(1, longest):
            ahead[t] = (ahead[t - 1] @ power) * emit[t]
            ahead[t] /= ahead[t].sum(axis=1, keepdims=True)
        back[sizes - 1, rows_at] = power[:, 0]
        for t in range(longest - 2, -1, -1):
            live = sizes > t + 1
            back[t, live] = (back[t + 1, live] * emit[t + 1, live]) @ power.T
            back[t, live] /= back[t, live].sum(axis=1, keepdims=True)
        chance = ahead * back
        chance /= chance.sum(axis=2, keepdims=True)
        want = by_features(chance[word_t, word_r])
        want_moves = np.zeros((k, k))
        want_moves[0] += chance[0].sum(axis=0)
        want_moves[:, 0] += chance[sizes - 1, rows_at].sum(axis=0)
        for t in range(1, longest):
            live = sizes > t
            here = emit[t, live] * back[t, live]
            total = ((ahead[t - 1, live] @ power) * here).sum(axis=1, keepdims=True)
            want_moves += power * (ahead[t - 1, live].T @ (here / total))
        slope = np.concatenate([true_weights - want, true_moves - want_moves]) / n - penalty * theta
        slope[quiet] = 0
        mean, var = 0.9 * mean + 0.1 * slope, 0.99 * var + 0.01 * slope**2
        theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    return Field(names, theta[: len(names)], theta[len(names) :])


# -- the labelled table -------------------------------------------------------------------------------------------

#: Common words of four languages, for the prose around.
_PROSE = (
    "the of and to in is that for it was on are with his they be this have from or had by but not what all were when we there can an your which their said if do will each about how up out them then she many some so these would other "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont "
    "el los se del las por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue please thanks office desk evening morning between Monday June"
).split()


def labelled_table(rows: int = TABLE_ROWS, seed: int = 1) -> list[tuple[list[str], list[str]]]:
    """(words, labels): plain words around one or two items, personal or only looking like it."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    lead = lambda n: rng.choice("123456789") + digits(n - 1)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    syllables = "an er on re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    made_up = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    word = lambda: rng.choice(_PROSE) if rng.random() < 0.6 else made_up()
    of = lambda group: rng.choice([w for w, g in TRIGGERS.items() if g == group])

    def card(size: int, valid: bool) -> str:
        body = rng.choice(["34", "37", "36", "4"]) + digits(size - 3)
        return next(body[: size - 1] + d for d in "0123456789" if luhn(body[: size - 1] + d) == valid) if len(body) >= size - 1 else next(body + d for d in "0123456789" if luhn(body + d) == valid)

    def cards() -> list[str]:
        number = card(rng.choice([13, 14, 15, 15]), True)
        return [number[:4], number[4:10], number[10:]] if len(number) >= 14 and rng.random() < 0.4 else [number]

    def email() -> list[str]:
        local = made_up() + rng.choice(["", ".", "_"]) + rng.choice([made_up(), digits(2), ""])
        host, top = rng.choice(["mail", "post", made_up()]) + rng.choice(["", "", digits(1)]), rng.choice(["com", "org", "net", "de", "fr", "co"])
        loose = rng.random() < 0.3
        opened, closed = rng.choice(["()", "[]", "{}"])
        sign = lambda w: [opened, w, closed] if loose else [opened + w + closed]
        way = rng.random()
        if way < 0.3:
            parts = [*rng.choice([[local], [made_up(), "dot", made_up()]]), "at", host, *rng.choice([[], ["dot", made_up()]]), "dot", top]
            return [p.upper() if p in ("at", "dot") else p for p in parts] if rng.random() < 0.2 else parts
        if way < 0.45:
            return [local, *sign("at"), f"{host}.{top}"]
        return [local, *sign("at"), host, *(["dot"] if rng.random() < 0.2 else sign("dot")), top]

    def phone() -> tuple[list[str], bool]:
        """Words, and whether they only pass for a phone number with a word such as "tel" before."""
        a, b, c = lead(3), lead(3), digits(4)
        clear = [[f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], [f"({a})", b, c], ["+1", f"({a})", f"{b}-{c}"], [f"+{lead(2)}", lead(2), digits(4), digits(4)], [f"({a}){b}-{c}"]]
        clear += [[f"0{lead(rng.randint(2, 4))}/{digits(rng.randint(6, 8))}"], [f"0{lead(3)}", digits(3), digits(4)], [f"0{lead(2)}", digits(4), digits(4)], [f"0{lead(1)}", *(digits(2) for _ in range(4))], [f"(0{lead(2)})", digits(4), digits(4)], [f"0{lead(3)}-{digits(7)}"], [f"00{lead(2)}", lead(2), digits(6)], [f"0{lead(4)}", digits(6)]]
        unclear = [[a, b, c], [lead(2), digits(3), digits(2), digits(2)], [a, digits(3), digits(3)], [f"{a}-{digits(5)}"], [f"{a}", f"{b}-{c}"], [a, b, digits(2), digits(2)]]
        return (rng.choice(clear), False) if rng.random() < 0.7 else (rng.choice(unclear), True)

    def address() -> list[str]:
        part = lambda: hexes(rng.randint(1, 4))
        few = lambda n: ":".join(part() for _ in range(n))
        letters = lambda: "".join(rng.choice("abcdef") for _ in range(4))
        return [rng.choice([few(8), f"2001:db8:{part()}::{part()}", f"fe80::{few(3)}", f"{few(rng.randint(1, 3))}::{few(rng.randint(1, 3))}", f"{letters()}:{letters()}::{letters()}", f"{few(4).upper()}::{part()}", ".".join(str(rng.randint(0, 255)) for _ in range(4))])]

    numbers = [
        lambda: [f"20{digits(2)}-0{lead(1)}-{rng.randint(10, 28)}"], lambda: [f"{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}"], lambda: [f"{lead(1)}.{digits(1)}.{digits(2)}"], lambda: [f"{lead(1)},{digits(3)}.{digits(2)}"], lambda: [lead(rng.randint(1, 12))],
        lambda: [card(rng.choice([13, 14, 15, 16, 16]), False)], lambda: ["#" + lead(5)], lambda: [f"978-3-{digits(2)}-{digits(6)}-{digits(1)}"], lambda: ["=", '"' + hexes(40) + '"'], lambda: ["password=" + hexes(16)], lambda: [f"({lead(rng.randint(1, 2))})"], lambda: [f"({rng.choice(['19', '20'])}{digits(2)})"],
        lambda: [f"{lead(1)}.{digits(1)}"], lambda: [f"{lead(2)}%"], lambda: [f"{lead(3)}-{digits(3)}"], lambda: [lead(3), lead(3), digits(4)], lambda: [lead(3), lead(4), lead(3)], lambda: [f"{lead(2)}-{lead(2)}"], lambda: [f"{lead(1)}/{digits(2)}/{digits(4)}"], lambda: [f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/20{digits(2)}"],
        lambda: [f"{rng.randint(256, 999)}.{lead(3)}.{lead(3)}.{lead(3)}"], lambda: [f"{lead(2)}.{lead(2)}.20{digits(2)}"], lambda: [lead(1), digits(3), digits(3)], lambda: [f"{lead(2)},", f"{lead(2)},", lead(2)], lambda: [f"{lead(4)}-{digits(4)}-{digits(4)}"], lambda: [f"{hexes(2)}:{hexes(2)}:{hexes(2)}:{hexes(2)}:{hexes(2)}:{hexes(2)}"], lambda: [f"19{digits(2)}", "to", f"20{digits(2)}"], lambda: [f"{lead(1)}:{digits(2)}"],
    ]
    phrases = [lambda: ["@" + word()], lambda: ["at", word()], lambda: [word(), "dot", word()], lambda: ["at", word(), word(), "dot"], lambda: ["at", "the", word()], lambda: ["dot", "com", word()], lambda: ["std::" + word() + "::" + word()], lambda: ["(", word(), ")"], lambda: ["at", f"{lead(1)}:{digits(2)}"], lambda: ["a", "dot", "at", "the", word()], lambda: ["(at", "least)"], lambda: [word(), "at", "a", "dot", "on", "the", word()]]
    table = []
    for _ in range(rows):
        words: list[str] = []
        labels: list[str] = []

        def add(new: list[str], kind: str | None = None) -> None:
            labels.extend(["O"] * len(new) if kind is None else [f"B-{kind}"] + [f"I-{kind}"] * (len(new) - 1))  # noqa: B023
            words.extend(new)  # noqa: B023

        for _ in range(rng.randint(1, 2)):
            add([w.capitalize() if rng.random() < 0.15 else w for w in (word() for _ in range(rng.randint(1, 5)))])
            if rng.random() < 0.5:
                kind = rng.choice(KINDS)
                new, told = (email(), False) if kind == "email" else (cards(), False) if kind == "card" else (address(), False) if kind == "ip" else phone()
                if told or rng.random() < 0.4:
                    intro = of({"email": "mail", "ip": "host"}.get(kind, kind))
                    add([rng.choice([intro, intro.capitalize()]) + rng.choice(["", ":", ".", "" if kind != "phone" else ":"])])
                    if rng.random() < 0.3:
                        add([rng.choice(["me", "us", "on", "at", "is", "under", "number", "nr."]) if kind != "email" else rng.choice(["me", "is", "to"])])
                if rng.random() < 0.1 and not new[0].startswith("("):
                    new = ["(" + new[0], *new[1:-1], new[-1] + ")"] if len(new) > 1 else [f"({new[0]})"]
                add(new, kind)
            elif rng.random() < 0.7:
                if rng.random() < 0.5:
                    add([of("number") + rng.choice(["", ":"])])
                add(rng.choice(numbers)())
            else:
                add(rng.choice(phrases)())
            if rng.random() < 0.2:
                words[-1] += rng.choice(".,;")
        add([word() for _ in range(rng.randint(0, 4))])
        table.append((words, labels))
    return table


@functools.lru_cache(1)
def standard_field() -> Field:
    return train(labelled_table())


def field_of(labelled: DataFrame, most_rows: int = MOST_ROWS) -> Field:
    """A field trained on a table of `words` and `labels` (arrays of equal length, labels of LABELS). At most `most_rows`
    rows are used; rows that are null, empty or of unequal lengths aren't. An empty table gives a field that adds nothing."""
    good = labelled.select("words", "labels").where("size(words) > 0 and size(words) = size(labels)")
    rows = [(list(r.words), list(r.labels)) for r in good.limit(most_rows).collect()]
    if unknown := {x for _, labels in rows for x in labels} - set(LABELS):
        raise ValueError(f"unknown labels: {sorted(map(str, unknown))}")
    return train(rows) if rows else train([(["a"], ["O"])])


# -- spans --------------------------------------------------------------------------------------------------------


_SPELT = re.compile(r"(?is)[^\s@]+(?:\s+dot\s+\S+)*\s*(?:[(\[{<]\s*at\s*[)\]}>]|\sat\s)\s*\S.*?(?:\.|[(\[{<]\s*dot\s*[)\]}>]|\sdot\s)\s*[a-z]{2,}")
_V6 = re.compile(r"(?=.*::|(?:[^:]+:){7})[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}")


def _holds(kind: str, found: str) -> bool:
    """The check of an added span."""
    digits = _NOT_DIGITS.sub("", found)
    if kind == "phone":
        return 8 <= len(digits) <= 15 and bool(re.fullmatch(r"[0-9 ()+./-]+", found)) and bool(re.search(r"[-(. /]", found))
    if kind == "card":
        return 13 <= len(digits) <= 15 and luhn(digits) and bool(re.fullmatch("[0-9 -]+", found))
    if kind == "ip":
        return found.count(":") >= 2 and bool(_V6.fullmatch(found)) and found.count("::") <= 1 and len(found) > 6
    return bool(_SPELT.fullmatch(found))


def _stretches(words: list[str], certified: bool) -> list[tuple[int, int]]:
    if not certified:
        return [(0, len(words))]
    out: list[tuple[int, int]] = []
    for i, w in enumerate(words):
        if not plain(w):
            lo, hi = max(0, i - REACH), min(len(words), i + REACH + 1)
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], hi)
            else:
                out.append((lo, hi))
    return out


def _bounds(kind: str, text: str, start: int, end: int) -> tuple[int, int]:
    """A span without quotes, stops and unpaired brackets around it."""
    left, right = (_EDGE_LEFT, _EDGE_RIGHT) if kind != "email" else ("\"'<", "\"'>.,;:!?")
    moved = True
    while moved and start < end:
        moved = False
        if text[start] in left or (text[start] == "(" and text.count("(", start, end) > text.count(")", start, end)):
            start, moved = start + 1, True
        elif text[end - 1] in right or (text[end - 1] == ")" and text.count(")", start, end) > text.count("(", start, end)):
            end, moved = end - 1, True
        elif kind != "phone" and text[start] == "(" and text[end - 1] == ")" and kind != "email":
            start, end, moved = start + 1, end - 1, True
    return start, end


def find_spans(texts: Sequence[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text the spans of the patterns and those that the field adds."""
    base = [pattern_spans(t) for t in texts]
    pending: list[tuple[int, list[re.Match[str]]]] = []
    stretches: list[np.ndarray] = []
    for row, text in enumerate(texts):
        if not _MATTERS.search(text):
            continue  # nothing that an added span could hold
        tokens = list(_WORD.finditer(text))
        words = [m[0] for m in tokens]
        for lo, hi in _stretches(words, field.certified):
            if not _MATTERS.search(text, tokens[lo].start(), tokens[hi - 1].end()):
                continue
            pending.append((row, tokens[lo:hi]))
            first = max(0, lo - REACH)
            stretches.append(field.scores(words[first : hi + REACH], range(lo - first, hi - first)))
    added: list[list[Span]] = [[] for _ in texts]
    for (row, tokens), labels in zip(pending, field.decode(stretches), strict=True):
        i = 0
        while i < len(labels):
            if labels[i] == 0:
                i += 1
                continue
            kind = LABELS[labels[i]][2:]
            j = i + 1
            while j < len(labels) and LABELS[labels[j]] == f"I-{kind}":
                j += 1
            start, end = _bounds(kind, texts[row], tokens[i].start(), tokens[j - 1].end())
            if start < end and _holds(kind, texts[row][start:end]) and not any(a < end and start < b for _, a, b in base[row]):
                added[row].append((kind, start, end))
            i = j
    return list(zip(base, added, strict=True))


SPAN = "array<struct<kind:string,start:int,end:int,by:string>>"


def _found(docs: DataFrame, text_col: str, redact: bool, keep: Sequence[str], labelled: DataFrame | None) -> DataFrame:
    """_keep (a struct of the columns `keep`), spans and, if asked for, redacted."""
    shared = docs.sparkSession.sparkContext.broadcast(standard_field() if labelled is None else field_of(labelled))
    rows = docs.select(F.struct(*keep).alias("_keep"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("by", pa.string())])
    out = pa.schema([("spans", pa.list_(span))] + [("redacted", pa.string())] * redact)
    rank = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            texts = batch.column("_text").to_pylist()
            columns: list[list[Any]] = [[], []]
            for text, (base, added) in zip(texts, find_spans(texts, shared.value), strict=True):
                both = sorted([(*s, "pattern") for s in base] + [(*s, "field") for s in added], key=lambda s: (rank[s[0]], s[1]))
                columns[0].append([dict(zip(("kind", "start", "end", "by"), s, strict=True)) for s in both])
                if redact:
                    columns[1].append(redacted(text, [s[:3] for s in both]))
            yield batch_of(out.insert(0, batch.schema.field("_keep")), [batch.column("_keep"), *columns[: len(out)]])

    kind = rows.schema["_keep"].dataType.simpleString()
    return rows.mapInArrow(run, f"_keep {kind}, spans {SPAN}" + ", redacted string" * redact)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False, labelled: DataFrame | None = None) -> DataFrame:
    """id, spans (kind, start, end, by 'pattern' or 'field') and, if asked for, redacted text. `labelled`: see `field_of`."""
    return _found(docs, text_col, redact, [id_col], labelled).select("_keep.*", "spans", *["redacted"] * redact)


def redact_documents(docs: DataFrame, text_col: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """All columns of `docs`, with the spans in the text replaced by the names of their kinds."""
    done = _found(docs, text_col, True, [c for c in docs.columns if c != text_col], labelled)
    return done.select(*[F.col("redacted").alias(c) if c == text_col else F.col("_keep")[c].alias(c) for c in docs.columns])


def redacted(text: str, spans: Sequence[Span]) -> str:
    """`text` with its spans replaced; of overlapping ones the first stands for all that they cover."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], SHOWN_AS[kind]]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
