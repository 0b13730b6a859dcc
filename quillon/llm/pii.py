"""Personal data by rules and a semi-Markov conditional random field.

The rules find well-formed e-mail addresses, IP addresses, card and phone numbers. The model finds the same kinds in
other shapes: it looks at islands, runs of neighbouring words that hold digits or an at sign, and scores whole spans in
them by features of the span as one thing (how many digits in which groups, check digit, separators, what stands around),
not of its tokens. Dynamic programming over the island's token boundaries, with a bounded length of an entity, chooses
the boundaries and kinds of all entities together. Its weights are fitted by conditional likelihood on generated
examples: shapes of each kind, and dates, prices, versions and serial numbers that are none.

A candidate has at most 20 tokens and 256 characters and begins and ends where a word does, so the work is linear in the text,
very long runs included.

Spans of the rules always stay; spans of the model are added where they overlap none of them.

Defined results: a null text counts as empty and has no spans; positions are code points, ends exclusive; spans of
different rules may overlap; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import lean, text_of

#: In the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")


@dataclass(frozen=True)
class PiiOptions:
    longest: int = 20  # tokens of an entity
    examples: int = 900
    epochs: int = 10
    seed: int = 7


Span = tuple[str, int, int]

# --- Rules -----------------------------------------------------------------------------------------------------------

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Matches end with a run of digits and so begin with one: the look-behind keeps long runs from being tried at each digit.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """From each at sign back to the start of its local part: the same as leftmost matches, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def rule_spans(text: str) -> list[Span]:
    """All spans of the rules, by kind as listed, then by start."""
    found: list[Span] = list(emails(text))
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


# --- Spans as a whole ------------------------------------------------------------------------------------------------

_AT = r"(?:[\[({]\s?at\s?[\])}])"
_DOT = r"(?:[\[({]\s?dot\s?[\])}])"
_SIGN = re.compile(rf"{_AT}|{_DOT}")
_MARK = re.compile(rf"{_AT}|{_DOT}|[0-9@]")
_RUN = re.compile(r"\S+")
_NAME = re.compile(r" ?[A-Za-z0-9.-]+")
_TOKEN = re.compile(rf"{_AT}|{_DOT}|[0-9]+|[A-Za-z]+|\s|.", re.S)
_GROUP = re.compile(r"[0-9]+")
_ADDRESS = re.compile(rf"^[A-Za-z0-9._%+-]+ ?(?:@|{_AT}) ?[A-Za-z0-9-]+(?: ?(?:\.|{_DOT}) ?[A-Za-z0-9-]+)+$")
#: Words before a span that hint at its kind.
_CUES = {
    "email": re.compile(r"(?i)(?:e-?mail|mail|contact|correo|courriel)\W*$"),
    "ip": re.compile(r"(?i)(?:\bip|host|address|server)\W*$"),
    "card": re.compile(r"(?i)(?:card|visa|mastercard|amex|carte|karte|tarjeta)\W*$"),
    "phone": re.compile(r"(?i)(?:phone|tel|call|mobile|fax|cell|telefon)\W*$"),
}
N_FEATURES = 32


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Where entities may stand: words with a digit or an at sign and spelled-out signs, one space apart, with the names around signs.

    Every step goes on from a mark, back to the end of the island before at most and forward over what the island takes, so
    the time is linear in the text.
    """
    done, mark = 0, _MARK.search(text)
    while mark:
        start, end = mark.span()
        if end - start > 1:  # a sign: the name before it
            name = start - 1 if start > done and text[start - 1] == " " else start
            while name > done and text[name - 1] in _LOCAL:
                name -= 1
            start = name if text[name : name + 1] in _LOCAL else start
        else:
            while start > done and not text[start - 1].isspace():
                start -= 1
            end = _RUN.match(text, start).end()
        while end < len(text):
            if text[end] in " \u00a0":
                if sign := _SIGN.match(text, end + 1):
                    end = sign.end()
                    continue
                run = _RUN.match(text, end + 1)
                if run and _MARK.search(text, *run.span()):
                    end = run.end()
                    continue
            elif sign := _SIGN.match(text, end):
                end = sign.end()
                continue
            if text[end - 1] in "])}" and (name := _NAME.match(text, end)):
                end = name.end()
                continue
            break
        yield start, end
        done = end
        mark = _MARK.search(text, end)



def span_features(text: str, start: int, end: int) -> tuple[float, ...]:
    return _features(text[start:end], text[max(0, start - 16) : start], text[end : end + 2])


@lru_cache(maxsize=65_536)
def _features(span: str, left: str, right: str) -> tuple[float, ...]:
    """Of a span, the 16 characters before it and the two after it."""
    groups = _GROUP.findall(span)
    sizes = tuple(len(g) for g in groups)
    digits = "".join(groups)
    n = len(digits)
    letters = sum(c.isalpha() for c in span)
    separators = {c for c in span if not c.isalnum()}
    before, after = left[-1:], right[:1]
    address = bool(_ADDRESS.match(span))
    quads = len(sizes) == 4 and span.count(".") == 3 and letters == 0
    f = [
        1,
        n < 7,
        n == 7,
        8 <= n <= 15,
        n in (10, 11),
        13 <= n <= 15,
        16 <= n <= 19,
        n > 19,
        16 <= n <= 19 and luhn(digits),
        13 <= n <= 15 and luhn(digits),
        span[0] == "+",
        span[0] == "(",
        span.count("(") == span.count(")") == 1,
        quads and all(len(g) <= 3 and int(g) <= 255 for g in groups),
        quads,
        len(sizes) >= 4 and set(sizes) == {4},
        sizes in ((3, 3, 4), (1, 3, 3, 4), (2, 3, 3, 4)),
        len(sizes) in (2, 3, 4, 5) and n >= 8 and max(sizes, default=0) <= 5,
        len(sizes) == 1,
        address,
        letters > 0 and not address,
        len(separators - set("()+")) > 1,
        bool(separators - set("()+-. ")) and not address,
        span.startswith("00"),
        before.isalnum() or (before != "" and before in "+.-/_@"),
        after.isalnum() or (after != "" and after in "/_@" or (after in "-." and right[1:].isalnum())),
        before == " " and left[-2:-1].isdigit(),
        after == " " and right[1:].isdigit(),
        bool(_CUES["email"].search(left)),
        bool(_CUES["ip"].search(left)),
        bool(_CUES["card"].search(left)),
        bool(_CUES["phone"].search(left)),
    ]
    return tuple([1.0 if x else 0.0 for x in f])


@dataclass
class Lattice:
    """Boundaries 0..n of an island's tokens; candidate spans between them and single tokens outside any entity."""

    n: int
    edges: list[tuple[int, int]]  # candidate spans, as boundaries, by their end
    places: list[tuple[int, int]]  # the same as positions in the text
    features: np.ndarray
    outside: np.ndarray  # for each token: (1, it holds a digit, an at sign)


#: Characters that a candidate span has at most.
WIDEST = 256
#: Tokens whose candidates are scored at once.
BATCH = 2_000


def lattice(text: str, start: int, end: int, longest: int) -> Lattice:
    """Candidates have at most ``longest`` tokens and ``WIDEST`` characters, and begin and end where a word does."""
    tokens = [m.span() for m in _TOKEN.finditer(text, start, end)]
    kinds = [text[a:b] for a, b in tokens]
    digits, signs = [0], [0]
    for t in kinds:
        digits.append(digits[-1] + t[0].isdigit() * len(t))
        signs.append(signs[-1] + (t == "@" or (len(t) > 2 and t[0] in "[({")))
    opens = [
        (t[0].isalnum() and not (a > 0 and text[a - 1].isalnum())) or t[0] in "+(" for t, (a, _) in zip(kinds, tokens, strict=True)
    ]
    edges, places, rows = [], [], []
    for j in range(1, len(tokens) + 1):
        b = tokens[j - 1][1]
        if not kinds[j - 1][-1].isalnum() or (b < len(text) and text[b].isalnum()):
            continue
        for i in range(j - 1, max(-1, j - 1 - longest), -1):
            a = tokens[i][0]
            if b - a > WIDEST:
                break
            if opens[i] and (digits[j] - digits[i] >= 7 or signs[j] > signs[i]):
                edges.append((i, j))
                places.append((a, b))
                rows.append(span_features(text, a, b))
    outside = np.array([(1.0, y > x, q > p) for x, y, p, q in zip(digits, digits[1:], signs, signs[1:], strict=False)], dtype=np.float64).reshape(-1, 3)
    return Lattice(len(tokens), edges, places, np.array(rows, dtype=np.float64).reshape(-1, N_FEATURES), outside)


@dataclass(frozen=True)
class SemiCrf:
    spans: np.ndarray  # (kinds, features)
    outside: np.ndarray  # (3,)

    def scores(self, x: Lattice) -> tuple[np.ndarray, np.ndarray]:
        return x.features @ self.spans.T, x.outside @ self.outside

    def decode(self, x: Lattice) -> list[tuple[str, int, int]]:
        """The best boundaries and kinds together."""
        if not x.edges:
            return []
        inside, outside = self.scores(x)
        kind = inside.argmax(axis=1)
        best = np.zeros(x.n + 1)
        back: list[int] = [-1] * (x.n + 1)
        e = 0
        for j in range(1, x.n + 1):
            best[j] = best[j - 1] + outside[j - 1]
            while e < len(x.edges) and x.edges[e][1] == j:
                value = best[x.edges[e][0]] + inside[e, kind[e]]
                if value > best[j]:
                    best[j], back[j] = value, e
                e += 1
        out, j = [], x.n
        while j > 0:
            if back[j] < 0:
                j -= 1
            else:
                out.append((KINDS[kind[back[j]]], *x.places[back[j]]))
                j = x.edges[back[j]][0]
        return out[::-1]

    def decode_text(self, text: str, start: int, end: int, longest: int) -> list[tuple[str, int, int]]:
        """What ``decode`` finds in an island, in memory that doesn't grow with it.

        Tokens pass in batches: of what lies behind, only the last ``longest`` boundaries are kept, and the best way to each. Where
        all these ways come from one boundary, what leads to that is settled and forgotten.
        """
        out: list[tuple[str, int, int]] = []
        # By boundary, from `base` on: where a token begins there, digits and signs so far, whether a span may begin, score, and the way.
        base, begin, digits, signs, opens = 0, [start], [0], [0], [False]
        best, back, kinds = [0.0], [0], [-1]
        tokens = _TOKEN.finditer(text, start, end)
        while batch := [m.span() for m in islice(tokens, BATCH)]:
            edges, rows, outside = [], [], []
            first = base + len(begin) - 1
            for a, b in batch:
                token = text[a:b]
                begin[-1] = a
                opens[-1] = (token[0].isalnum() and not (a > 0 and text[a - 1].isalnum())) or token[0] in "+("
                digits.append(digits[-1] + token[0].isdigit() * len(token))
                signs.append(signs[-1] + (token == "@" or (len(token) > 2 and token[0] in "[({")))
                begin.append(b)
                opens.append(False)
                outside.append((1.0, digits[-1] > digits[-2], signs[-1] > signs[-2]))
                j = len(begin) - 1
                if not token[-1].isalnum() or (b < len(text) and text[b].isalnum()):
                    continue
                for i in range(j - 1, max(-1, j - 1 - longest), -1):
                    if b - begin[i] > WIDEST:
                        break
                    if opens[i] and (digits[j] - digits[i] >= 7 or signs[j] > signs[i]):
                        edges.append((base + i, base + j))
                        rows.append(span_features(text, begin[i], b))
            inside = np.array(rows, dtype=np.float64).reshape(-1, N_FEATURES) @ self.spans.T
            alone = (np.array(outside, dtype=np.float64) @ self.outside).tolist()
            kind = inside.argmax(axis=1).tolist()
            value = inside.max(axis=1).tolist() if len(rows) else []
            e = 0
            for j in range(first + 1, first + 1 + len(batch)):
                score, way, of = best[-1] + alone[j - first - 1], j - 1, -1
                while e < len(edges) and edges[e][1] == j:
                    one = best[edges[e][0] - base] + value[e]
                    if one > score:
                        score, way, of = one, edges[e][0], kind[e]
                    e += 1
                best.append(score)
                back.append(way)
                kinds.append(of)
            # The latest boundary that all ways to the last ones pass.
            last = base + len(begin) - 1
            alive = set(range(max(base, last - longest), last + 1))
            while len(alive) > 1:
                j = max(alive)
                alive.discard(j)
                alive.add(back[j - base] if j > base else base)
            settled = alive.pop()
            out += self._spans(base, settled, begin, back, kinds)
            drop = settled - base
            for column in (begin, digits, signs, opens, best, back, kinds):
                del column[:drop]
            base = settled
        return out + self._spans(base, base + len(begin) - 1, begin, back, kinds)

    @staticmethod
    def _spans(base: int, j: int, begin: list[int], back: list[int], kinds: list[int]) -> list[tuple[str, int, int]]:
        """The spans on the way from boundary `base` to j. A span ends where its last token does."""
        out = []
        while j > base:
            i = back[j - base]
            if kinds[j - base] >= 0:
                out.append((KINDS[kinds[j - base]], begin[i - base], begin[j - base]))
            j = i
        return out[::-1]

    def gradient(self, x: Lattice, truth: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
        """Observed less expected features. truth: place -> kind."""
        inside, outside = self.scores(x)
        a, b = np.full(x.n + 1, -np.inf), np.full(x.n + 1, -np.inf)
        a[0] = b[x.n] = 0.0
        e = 0
        for j in range(1, x.n + 1):
            terms = [a[j - 1] + outside[j - 1]]
            while e < len(x.edges) and x.edges[e][1] == j:
                terms += (a[x.edges[e][0]] + inside[e]).tolist()
                e += 1
            a[j] = np.logaddexp.reduce(terms)
        ends: list[list[int]] = [[] for _ in range(x.n + 1)]
        for e, (i, _) in enumerate(x.edges):
            ends[i].append(e)
        for i in range(x.n - 1, -1, -1):
            terms = [b[i + 1] + outside[i]]
            for e in ends[i]:
                terms += (b[x.edges[e][1]] + inside[e]).tolist()
            b[i] = np.logaddexp.reduce(terms)
        z = a[x.n]
        chance_out = np.exp(a[:-1] + outside + b[1:] - z)
        spans, free = np.zeros_like(self.spans), np.ones(x.n)
        if x.edges:
            i, j = np.array(x.edges).T
            chance = np.exp(a[i][:, None] + inside + b[j][:, None] - z)
            spans -= chance.T @ x.features
            for e, place in enumerate(x.places):
                if place in truth:
                    spans[truth[place]] += x.features[e]
                    free[x.edges[e][0] : x.edges[e][1]] = 0
        return spans, x.outside.T @ (free - chance_out)


# --- Fitting on generated examples -----------------------------------------------------------------------------------


def _number(r: random.Random, n: int) -> str:
    return str(r.randint(1, 9)) + "".join(str(r.randint(0, 9)) for _ in range(n - 1))


def _entity(r: random.Random, kind: str) -> str:
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))
    if kind == "email":
        at = r.choice(["@", "@", " (at) ", "[at]", " [at] ", "(at)"])
        dot = "." if at == "@" else r.choice([".", " (dot) ", "[dot]", "(dot)"])
        return f"{word()}{r.choice(['', '.' + word(), _number(r, 2)])}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de'])}"
    if kind == "ip":
        return ".".join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        body = r.choice("3456") + _number(r, 14)
        number = next(body + c for c in "0123456789" if luhn(body + c))
        parts = [number[i : i + 4] for i in range(0, 16, 4)]
        return r.choice([number, " ".join(parts), "-".join(parts), ".".join(parts)])
    a, b, c = _number(r, 3), _number(r, 3), _number(r, 4)
    return r.choice(
        [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+1 ({a}) {b}-{c}", f"+49 {a} {b}{c}",
         f"0{_number(r, 2)} {b} {c}", f"00{_number(r, 2)} {a} {b} {c}", f"+{_number(r, 2)}-{a}-{b}-{c}", f"1-{a}-{b}-{c}"]
    )


def _other(r: random.Random) -> str:
    return r.choice(
        [
            f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
            f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}",
            f"{_number(r, r.randint(1, 3))},{_number(r, 3)}.{_number(r, 2)}",
            f"{r.randint(1, 20)}.{r.randint(0, 20)}.{r.randint(0, 400)}",
            f"{r.randint(300, 999)}.{r.randint(300, 999)}.{r.randint(0, 999)}.{r.randint(0, 999)}",
            _number(r, r.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 20, 24])),
            "ab" + _number(r, r.randint(7, 16)),
            f"{_number(r, 9)}/{_number(r, 5)}",
            f"{_number(r, 4)} {_number(r, 4)}",
            f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}",
            _bad_card(r),
            _bad_card(r),
            "-".join(_bad_card(r)[i : i + 4] for i in range(0, 16, 4)),
            "".join(r.choice("0123456789abcdef") for _ in range(r.randint(12, 40))),
            f'"{"".join(r.choice("0123456789abcdef") for _ in range(r.randint(12, 40)))}"',
            "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(20)),
            f"key={_number(r, r.randint(6, 12))}{r.choice('abcdef')}{_number(r, 4)}",
        ]
    )


def _bad_card(r: random.Random) -> str:
    body = _number(r, 15)
    return next(body + c for c in "0123456789" if not luhn(body + c))


_CUE_WORDS = {"email": "mail:", "ip": "host", "card": "card", "phone": "tel:"}


def examples(options: PiiOptions) -> list[tuple[Lattice, dict[tuple[int, int], int]]]:
    r = random.Random(options.seed)
    out = []
    for i in range(options.examples):
        kind = KINDS[i % len(KINDS)] if i % 3 else None
        piece = _entity(r, kind) if kind else _other(r)
        cue = _CUE_WORDS[kind] + " " if kind and r.random() < 0.3 else "word "
        text = f"{cue}{piece}{r.choice([' end', '. End', ', end', ''])}"
        start = len(cue)
        for island in islands(text):
            x = lattice(text, *island, options.longest)
            place = (start, start + len(piece))
            out.append((x, {place: KINDS.index(kind)} if kind and place in x.places else {}))
    return out


def fit(options: PiiOptions = PiiOptions()) -> SemiCrf:
    """Stochastic ascent of the penalised conditional likelihood, in a fixed order."""
    data = examples(options)
    spans, outside = np.zeros((len(KINDS), N_FEATURES)), np.zeros(3)
    seen_spans, seen_outside = np.full_like(spans, 1e-6), np.full_like(outside, 1e-6)
    order = random.Random(options.seed + 1)
    for _ in range(options.epochs):
        order.shuffle(data)
        for x, truth in data:
            g, h = SemiCrf(spans, outside).gradient(x, truth)
            g, h = g - 0.002 * spans, h - 0.002 * outside
            seen_spans += g * g
            seen_outside += h * h
            spans = spans + 0.5 * g / np.sqrt(seen_spans)
            outside = outside + 0.5 * h / np.sqrt(seen_outside)
    return SemiCrf(spans, outside)


_fitted = cache(fit)

# --- Whole texts -----------------------------------------------------------------------------------------------------

_HINT = re.compile(rf"[0-9@]|{_AT}")


def all_spans(text: str, model: SemiCrf, longest: int) -> tuple[list[Span], list[Span]]:
    """(spans of the rules, all spans), both by kind as listed, then by start."""
    if not _HINT.search(text):
        return [], []
    base = rule_spans(text)
    taken: list[list[int]] = []  # what the rules cover, apart and in order
    for _, a, b in sorted(base, key=lambda x: x[1:]):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    begins = [a for a, _ in taken]
    added = []
    for island in islands(text):
        for kind, a, b in model.decode_text(text, *island, longest):
            i = bisect_left(begins, b)
            if not i or taken[i - 1][1] <= a:
                added.append((kind, a, b))
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long,rule:boolean>>"


def find_spans(docs: DataFrame, options: PiiOptions = PiiOptions()) -> DataFrame:
    """doc_id, spans (kind, start, end, rule) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(_fitted(options))
    longest = options.longest
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("rule", pa.bool_())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).cast(pa.large_string()):
                base, spans = all_spans(text.as_py(), shared.value, longest)
                of_rules = set(base)
                out.append([{"kind": k, "start": a, "end": b, "rule": (k, a, b) in of_rules} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.list_(item))], names=["doc_id", "spans"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return lean(narrow).mapInArrow(find, SPANS)


def span_report(docs: DataFrame, options: PiiOptions = PiiOptions()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    base = F.filter("spans", lambda s: s["rule"])
    coded = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find_spans(docs, options).select(
        "doc_id",
        *[number(k) for k in KINDS],
        F.sha2(coded(base), 256).alias("base_sha256"),
        coded(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, options: PiiOptions = PiiOptions()) -> DataFrame:
    """docs with every span replaced by its kind in square brackets; overlapping spans are replaced as one."""
    model = docs.sparkSession.sparkContext.broadcast(_fitted(options))
    at, longest = docs.columns.index("text"), options.longest

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                if text:
                    out, done = [], 0
                    for kind, a, b in sorted(all_spans(text, model.value, longest)[1], key=lambda s: (s[1], -s[2])):
                        if a >= done:
                            out += [text[done:a], f"[{kind}]"]
                        done = max(done, b)
                    text = "".join([*out, text[done:]])
                texts.append(text)
            columns = [pa.array(texts, type=pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(clean, docs.schema)
