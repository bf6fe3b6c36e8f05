"""Personal data: exact base patterns, and a semi-Markov conditional random field for what has no fixed form.

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone numbers by pattern and check.
The random field adds ``secret`` (keys, tokens, passwords), ``contact`` (addresses spelt out, such as
"name at host dot org"), ``iban`` (account numbers) and ``birth`` (dates of birth). It scores whole candidate
segments of tokens: length, letters and digits, entropy, changes between kinds of signs, check digits, shape and the words before
them. Dynamic programming over segments of at most ``LONGEST`` tokens chooses borders and types together, over
the whole text. Tokens outside segments score 0. Weights maximise the conditional likelihood of seeded sentences of
three generators (prose, settings, logs; forward-backward over segments, numpy), so no row of the corpus is
learnt from.

A segment without any sign of its kind (no token with letters and digits, no "dot", no year ...) has one
feature, ``none``, which is never right in training; its weight is below 0, which is checked, so such a segment is in
no best segmentation. Hence only segments around tokens with a sign are scored, with the same result as if all were.
Segments that overlap a base span are dropped.

Defined cases: null and empty texts have no spans; positions are code points, ends exclusive; equal rows are
returned each; texts and runs of any length are handled in linear time; further columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowio import arrow_map, pieces
from .util import read

BASE_KINDS, OWN_KINDS = ("email", "ip", "card", "phone"), ("secret", "contact", "iban", "birth")
LONGEST = {"secret": 3, "contact": 13, "iban": 9, "birth": 5}
SENTENCES, EPOCHS, KEPT_TOKENS = 900, 8, 300_000
#: Tokens before a segment in which a word can announce it.
REACH = 5
#: The base patterns. A run of digits is entered at its start alone, which finds the same matches in linear time.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
TOKEN = re.compile(r"[\w/+=-]+|[^\s\w/+=-]+")
#: Words that announce a segment, and words for signs and months.
CUES = frozenset("secret token password passwd passwort contraseña pwd pin api key apikey api_key api-key auth bearer credential credentials access_token client_secret private_key".split())
LINKS = frozenset(["=", ":", "is", ":=", "==", "=>", "->", "ist", "es", "est"])
AT, DOT, BRACKETS = frozenset(["at", "arroba"]), frozenset(["dot", "punkt", "punto"]), frozenset("( ) [ ] { } < >".split())
BIRTH = frozenset("born birth dob birthday birthdate geboren geburtsdatum né née naissance nacido nacida nacimiento".split())
MONTHS = frozenset("january february march april may june july august september october november december januar februar märz mai juni juli oktober dezember janvier février mars avril juin juillet août septembre octobre novembre décembre enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split())
YEAR = re.compile(r"(?:19|20)[0-9]{2}")
DATE = re.compile(r"(?:19|20)[0-9]{2}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/](?:19|20)[0-9]{2}")
ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]*")
RANDOM, CUE, SPELT, BANK, DATED = 1, 2, 4, 8, 16


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping; at each '@' the local part reaches back to the first sign outside its class."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    digit = DIGIT.search(text)
    if not digit:
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text, digit.start()) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.groups())]
    for m in CARD.finditer(text, digit.start()):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def mixed_or_long(token: str) -> bool:
    """Signs of a secret that need no word before it."""
    return len(token) >= 20 or (len(token) >= 6 and any(c.isdigit() for c in token) and any(c.isalpha() for c in token))


def signs_of(token: str) -> int:
    """Which kinds of segments may stand at or, for a word that announces secrets, after a token."""
    low = token.lower()
    return (
        RANDOM * mixed_or_long(token)
        | CUE * (low.strip("=:-") in CUES)
        | SPELT * (low in DOT)
        | BANK * bool(ACCOUNT.fullmatch(token))
        | DATED * bool(YEAR.fullmatch(token) or DATE.fullmatch(token))
    )


def _secret(span: list[str], glued: list[bool], before: list[str]) -> list[str]:
    cue = any(b.strip("=:-") in CUES for b in before)
    if not all(glued) or not (any(map(mixed_or_long, span)) or (cue and any(len(t) >= 4 and (any(c.isdigit() for c in t) or any(c.isupper() for c in t[1:])) for t in span))):
        return ["secret:none"]
    whole = "".join(span)
    n = len(whole)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in whole]
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(whole).values())
    changes = sum(x != y for x, y in zip(kinds, kinds[1:])) / n
    runs = max((len(r) for r in re.findall("[a-z]+|[A-Z]+", whole)), default=0)
    held = "".join(sorted(set(kinds)))
    link = bool(before) and (before[-1] in LINKS or (len(before) > 1 and before[-1] in "\"'`(<[" and before[-2] in LINKS))
    return [
        "secret:bias", f"secret:n{len(span)}", f"secret:len{min(n, 48) // 6}", f"secret:bits{int(min(entropy, 5))}", f"secret:of{held}", f"secret:changes{int(min(changes, 0.7) * 10)}",
        f"secret:runs{min(runs, 12) // 3}", f"secret:cue{int(cue)}{int(link)}", f"secret:hex{int(bool(re.fullmatch('[0-9a-f]+', whole)) and n >= 16)}", f"secret:odd{int(any(not c.isalnum() and c not in '_/+=-' for c in whole))}",
        f"secret:path{min(2, sum(c in '/-=' for c in whole))}{int(n >= 16)}",
    ]


def _contact(span: list[str], glued: list[bool], before: list[str]) -> list[str]:
    low = [t.lower() for t in span]
    if not any(t in DOT for t in low):
        return ["contact:none"]
    shape = "".join("A" if t in AT else "D" if t in DOT else "w" if t.isalnum() else "b" if t in BRACKETS else "p" for t in low)
    core = shape.replace("b", "")
    return [
        "contact:bias", f"contact:n{len(span)}", f"contact:ends{shape[0]}{shape[-1]}", f"contact:host{int(2 <= len(low[-1]) <= 6 and low[-1].isalpha())}", f"contact:whole{int(bool(re.fullmatch('wAw(?:Dw)+', core)))}",
        f"contact:at{core.count('A')}", f"contact:words{int('ww' in core)}", f"contact:signs{int('p' in core)}", f"contact:paired{int(shape.count('b') % 2)}",
    ]


def _iban(span: list[str], glued: list[bool], before: list[str]) -> list[str]:
    whole = "".join(span)
    if not ACCOUNT.fullmatch(span[0]) or not 15 <= len(whole) <= 34 or not (whole.isascii() and whole.isalnum() and whole == whole.upper()):
        return ["iban:none"]
    number = int("".join(str(int(c, 36)) for c in whole[4:] + whole[:4]))
    return ["iban:bias", f"iban:right{int(number % 97 == 1)}", f"iban:groups{int(len(span) == 1 or all(len(t) == 4 for t in span[:-1]))}", f"iban:cue{int('iban' in before or 'account' in before)}"]


def _birth(span: list[str], glued: list[bool], before: list[str]) -> list[str]:
    shape = "".join("t" if DATE.fullmatch(t) else "y" if YEAR.fullmatch(t) else "n" if t.isdigit() and len(t) <= 2 else "m" if t.lower() in MONTHS else "." if t in {".", ","} else "x" for t in span)
    if shape not in {"t", "n.n.y", "nmy", "n.my", "mn.y", "mny"}:
        return ["birth:none"]
    return ["birth:bias", f"birth:{shape}", f"birth:cue{int(any(b in BIRTH for b in before))}"]


FEATURES = {"secret": _secret, "contact": _contact, "iban": _iban, "birth": _birth}


def segment_features(tokens: list[str], glued: list[bool], i: int, j: int, kind: str) -> list[str]:
    """Features of tokens[i:j] as one segment of ``kind``; ``glued`` tells whether a token follows the one before it at once."""
    return [] if kind == "O" else FEATURES[kind](tokens[i:j], glued[i + 1 : j], [t.lower() for t in tokens[max(0, i - REACH) : i]])


def tokenised(text: str) -> tuple[list[str], list[bool], list[tuple[int, int]]]:
    """(tokens, whether glued to the one before, places)."""
    places = [m.span() for m in TOKEN.finditer(text)]
    return [text[a:b] for a, b in places], [bool(k) and places[k - 1][1] == a for k, (a, _) in enumerate(places)], places


def segments(n: int) -> list[tuple[int, int, str]]:
    return [(i, j, kind) for i in range(n) for kind, most in (("O", 1), *LONGEST.items()) for j in range(i + 1, min(n, i + most) + 1)]


def _account(rng: random.Random) -> str:
    rest = "".join(rng.choice("0123456789") for _ in range(rng.randint(12, 20)))
    land = rng.choice(["DE", "FR", "ES", "GB", "NL", "CH"])
    check = 98 - int("".join(str(int(c, 36)) for c in rest + land + "00")) % 97
    whole = f"{land}{check:02d}{rest}"
    return whole if rng.random() < 0.5 else " ".join(whole[k : k + 4] for k in range(0, len(whole), 4))


def _day(rng: random.Random) -> str:
    d, m, y = rng.randint(1, 28), rng.randint(1, 12), rng.randint(1920, 2024)
    month = rng.choice(["March", "may", "Juni", "octobre", "enero", "December"])
    return rng.choice([f"{y}-{m:02d}-{d:02d}", f"{d}/{m}/{y}", f"{d:02d}.{m:02d}.{y}", f"{d} {month} {y}", f"{month} {d}, {y}", f"{d}. {month} {y}"])


def _drawn(rng: random.Random) -> str:
    chars = rng.choice(["0123456789abcdef", "abcdefghijkmnopqrstuvwxyzABCDEFGHIJKLMNP0123456789", "abcdefgh0123456789-_", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"])
    return "".join(rng.choice(chars) for _ in range(rng.randint(8, 44))) + rng.choice("0123456789") + rng.choice("abcdef")


def _sentences(rng: random.Random, n: int = SENTENCES) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Generated texts with their spans, by three generators in turn."""
    syllables = "an er in on re ti th ver la de ch us mo ka li so ent por ä é".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    number = lambda: str(rng.randint(0, 10 ** rng.randint(1, 6)))
    drawn = lambda: _drawn(rng)
    dots = lambda: " ".join(f"{d} {rng.choice(['com', 'org', 'net', 'de', 'fr', 'info'])}" for d in [rng.choice(["dot", "(dot)", "[dot]", "punto"])] * rng.randint(1, 2))
    cue = lambda: rng.choice(["token", "secret", "password", "key", "api_key", "Passwort", "pin", "Bearer"])
    for turn in range(n):
        parts: list[tuple[str, str | None]] = []

        def add(text: str, kind: str | None = None, parts: list = parts) -> None:
            parts.append((text, kind))

        if turn % 3 == 0:  # prose
            add(" ".join(rng.choice([word(), word(), word().title(), number()]) for _ in range(rng.randint(0, 6))) + " ")
            pick = rng.randint(-2, 8)
            if pick == 0:
                add(rng.choice(["my ", "the ", ""]) + cue() + rng.choice([" is ", ": ", " = "]))
                add(rng.choice([drawn(), word().title() + number() + "x1", word() + str(rng.randint(10, 9999))]), "secret")
            elif pick <= 2:
                add(f"{word()} {rng.choice(['at', '(at)', '[at]', 'arroba'])} {word()} {dots()}", "contact")
            elif pick == 3:
                add(rng.choice(["IBAN ", "account: ", "to ", ""]))
                add(_account(rng), "iban")
            elif pick == 4:
                add(rng.choice(["born on ", "born ", "date of birth: ", "DOB ", "geboren am ", "née le ", "nacido el "]))
                add(_day(rng), "birth")
            elif pick == 5:
                add(rng.choice(["on ", "since ", "in ", ""]) + _day(rng) + " ")
                add(f"{rng.choice(['at', 'the', cue()])} {word()} {rng.choice([': ' + word() + ' dot', 'dot ' + word() + ' at', 'is ' + word() + ' dot ' + number(), 'dot ' + word(), 'at ' + word()])} ")
            elif pick == 6:
                add("".join(rng.choice(syllables) for _ in range(rng.randint(8, 14))) + " " + rng.choice("=-_*#") * rng.randint(1, 60))
            elif pick == 7:
                add(rng.choice([f"{word()}{rng.choice('-/')}{word()}{rng.choice('-/')}{number()}", f"{word()}{number()}", f"{number()}{word()}", f"https://{word()}.org/{word()}/{word()}-{word()}-{number()}", f"{word().upper()}-{number()}", f"{word()}{word().title()}{rng.randint(1, 99)}", f"{word().title()}{rng.randint(1, 2030)}", f"{word()}.{number()}@"]))
            add(" " + " ".join(rng.choice([word(), ".", ",", '"']) for _ in range(rng.randint(0, 4))))
        elif turn % 3 == 1:  # settings and code
            name = rng.choice([cue(), f"{word()}_{cue()}", f"{word()}.{word()}", word(), "client_secret", "password"])
            quote = rng.choice(['"', "'", ""])
            add(rng.choice(["", "export ", "  ", '{"', "- "]) + name + rng.choice([" = ", ": ", "=", ":", '": ', " := "]) + quote)
            if rng.random() < 0.5 and any(c in name.lower() for c in ("secret", "token", "passw", "key", "pin", "bearer")):
                add(drawn(), "secret")
            else:
                add(rng.choice([word(), number(), "true", f"/{word()}/{word()}/{word()}", f"{word()}_{word()}_{word()}", f"{number()}.{number()}.{number()}", _day(rng)]))
            add(quote + rng.choice(["", ";", ",", "}", f" # {word()} {word()}"]))
        else:  # logs and tables
            add(rng.choice([f"{rng.randint(1990, 2024)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d} {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:00 ", f"[{word()}] ", f"{number()} | "]))
            pick = rng.randint(0, 3)
            if pick == 0:
                add(rng.choice(["Authorization: Bearer ", "auth token ", "using key ", "x-api-key: ", ""]))
                add("".join(rng.choice("abcdefghijkmnopqrstuvwxyzABCDEFGHIJKLMNP0123456789") for _ in range(rng.randint(24, 48))) + "7", "secret")
            elif pick == 1:
                add(f"{word()} {rng.choice(['INFO', 'WARN', 'id=' + number(), 'v' + number() + '.' + number(), word() + '-' + word() + '-' + number()])}")
            elif pick == 2:
                add(rng.choice(["birth=", "dob | ", "birthdate: "]))
                add(_day(rng), "birth")
            else:
                add(f"{word()} {number()}ms {word()}{number()} {word().title()}{word().title()} {number()}%")
            add(rng.choice(["", f" {word()}", f" | {number()}", "."]))
        text, gold = "", []
        for part, kind in parts:
            if kind:
                gold.append((len(text), len(text) + len(part), kind))
            text += part
        yield text, gold


def as_tokens(text: str, gold: list[tuple[int, int, str]]) -> tuple[list[str], list[bool], list[tuple[int, int, str]]]:
    """Tokens, glue, and spans in tokens."""
    tokens, glued, places = tokenised(text)
    starts, ends = {a: k for k, (a, _) in enumerate(places)}, {b: k + 1 for k, (_, b) in enumerate(places)}
    return tokens, glued, [(starts[a], ends[b], kind) for a, b, kind in gold if a in starts and b in ends]


@lru_cache(maxsize=2)
def train(seed: int = 9) -> dict[str, float]:
    """Weights by stochastic gradient ascent on the conditional log-likelihood of segmentations."""
    rng = random.Random(seed)
    data = []
    for text, gold in _sentences(rng):
        tokens, glued, spans = as_tokens(text, gold)
        if tokens:
            segs = segments(len(tokens))
            inside = {k for i, j, _ in spans for k in range(i, j)}
            right = set(spans) | {(k, k + 1, "O") for k in range(len(tokens)) if k not in inside}
            feats = [segment_features(tokens, glued, *s) for s in segs]
            # The signs hold for every segment that is right, so `none` is never right.
            data.append((len(tokens), segs, feats, {s for s, f in zip(segs, feats) if s in right and not any(x.endswith(":none") for x in f)}))
    w: dict[str, float] = {f"{kind}:none": -1.0 for kind in OWN_KINDS}
    for epoch in range(EPOCHS):
        rng.shuffle(data)
        rate = 0.4 / (1 + epoch)
        for n, segs, feats, gold in data:
            score = [sum(w.get(f, 0.0) for f in fs) for fs in feats]
            ahead, behind = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
            ahead[0] = behind[n] = 0.0
            for k, (i, j, _) in enumerate(segs):  # in the order of starts
                ahead[j] = _add(ahead[j], ahead[i] + score[k])
            for k in range(len(segs) - 1, -1, -1):
                i, j, _ = segs[k]
                behind[i] = _add(behind[i], behind[j] + score[k])
            for k, (i, j, _) in enumerate(segs):
                p = math.exp(ahead[i] + score[k] + behind[j] - ahead[n])
                step = rate * ((segs[k] in gold) - p)
                if abs(step) > 1e-6:
                    for f in feats[k]:
                        w[f] = w.get(f, 0.0) + step
    if any(w[f"{kind}:none"] >= 0 for kind in OWN_KINDS):
        raise ValueError("a segment without signs of its kind must score below 0")
    return w


def _add(x: float, y: float) -> float:
    """log(exp(x) + exp(y))"""
    if x < y:
        x, y = y, x
    return x if y == -math.inf else x + math.log1p(math.exp(y - x))


def best_segments(tokens: list[str], glued: list[bool], w: dict[str, float]) -> list[tuple[int, int, str]]:
    """The best segmentation with every segment scored (:func:`own_spans` leaves out those that can't take part)."""
    every = [(i, j, kind) for i, j, kind in segments(len(tokens)) if kind != "O"]
    return _best(len(tokens), [(s, sum(w.get(f, 0.0) for f in segment_features(tokens, glued, *s))) for s in every])


def _best(n: int, scored: list[tuple[tuple[int, int, str], float]]) -> list[tuple[int, int, str]]:
    """Disjoint segments of the highest sum; of equal sums the one with the later first difference in (end, start, kind) loses."""
    ends: dict[int, list] = {}
    for (i, j, kind), score in scored:
        if score > 0:
            ends.setdefault(j, []).append((i, kind, score))
    best, back = {0: 0.0}, {}
    at, order = [0], sorted(ends)
    for j in order:
        best[j] = best[at[-1]]
        for i, kind, score in sorted(ends[j]):
            below = at[bisect_right(at, i) - 1]
            if best[below] + score > best[j]:
                best[j], back[j] = best[below] + score, (i, j, kind)
        at.append(j)
    out, k = [], len(at) - 1
    while k > 0:
        if (s := back.get(at[k])) is None:
            k -= 1
        else:
            out.append(s)
            k = bisect_right(at, s[0]) - 1
    return out[::-1]


class Signs(dict):
    """Signs by token, in a table of bounded size."""

    def __missing__(self, token: str) -> int:
        found = signs_of(token)
        if len(token) <= 40:
            if len(self) >= KEPT_TOKENS:
                self.clear()
            self[token] = found
        return found


def own_spans(text: str, w: dict[str, float], known: Signs | None = None) -> list[tuple[str, int, int]]:
    """Segments of the random field on the whole text."""
    known = Signs() if known is None else known
    found = list(map(known.__getitem__, TOKEN.findall(text)))
    if not any(found):
        return []
    tokens, glued, places = tokenised(text)
    n = len(tokens)
    tried: set[tuple[int, int, str]] = set()
    around = lambda t, kind: {(i, j, kind) for i in range(max(0, t - LONGEST[kind] + 1), t + 1) for j in range(t + 1, min(n, i + LONGEST[kind]) + 1)}
    for t, signs in enumerate(found):
        if signs:
            if signs & RANDOM:
                tried |= around(t, "secret")
            if signs & CUE:
                tried |= {(i, j, "secret") for i in range(t + 1, min(n, t + REACH + 1)) for j in range(i + 1, min(n, i + LONGEST["secret"]) + 1)}
            if signs & SPELT:
                tried |= around(t, "contact")
            if signs & BANK:
                tried |= {(t, j, "iban") for j in range(t + 1, min(n, t + LONGEST["iban"]) + 1)}
            if signs & DATED:
                tried |= around(t, "birth")
    best = _best(n, [(s, sum(w.get(f, 0.0) for f in segment_features(tokens, glued, *s))) for s in sorted(tried)])
    return [(kind, places[i][0], places[j - 1][1]) for i, j, kind in best]


def find(text: str, w: dict[str, float], known: Signs | None = None) -> list[tuple[str, int, int]]:
    base = base_spans(text)
    own = own_spans(text, w, known)
    return base + [s for s in own if not any(a < s[2] and s[1] < b for _, a, b in base)] if own else base


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, spans array<struct<kind, start, end>> in the order of kinds, then of starts."""
    weights = docs.sparkSession.sparkContext.broadcast(train())
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rank = {k: i for i, k in enumerate((*BASE_KINDS, *OWN_KINDS))}
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, known = weights.value, Signs()
        for batch, texts in pieces(batches, "text"):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in sorted(find(t, w, known), key=lambda s: (rank[s[0]], s[1]))] for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, kind)], names=["id", "spans"])

    return arrow_map(slim, run, f"id {slim.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def op7_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(read(spark, sf_dir, "documents"))
    digest = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in BASE_KINDS], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), *[count(k) for k in OWN_KINDS], F.size("spans").cast("long").alias("n_spans"))
