"""Personal data by a semi-Markov conditional random field beside four fixed patterns.

The field scores whole candidate spans of at most ``LONGEST`` tokens by features of the span as a unit
(shape, digits, checksums, the word before it), and dynamic programming over the tokens jointly chooses
boundaries and types; a segment of a type needs a digit or an at sign, so only tokens near one take
part and all others are outside any span. Weights come from maximising the likelihood of sentences
that ``examples`` generates from a fixed seed. Spans of the patterns always stay; a span of the field is
added where it meets none of them.

Defined cases: a null text is empty and has no span; other null columns do not matter; repeated rows get
equal results; of segmentations that score alike the first found stays, which has fewer and shorter spans;
very long texts are worked on as a whole, in time that grows with their length; an empty table gives an
empty result; columns that clash with the result's are replaced.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
LONGEST = 5
EXAMPLES, ROUNDS, RATE = 900, 6, 0.3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_EDGES = "\"'.,;:!?()[]{}<>#$%&*|=`"
_NAMED = re.compile(r"(?i)^(?:token|secret|password|passwd|pwd|api[_-]?key|key|bearer|auth)$")
_CALL = re.compile(r"(?i)^(?:call|tel|phone|fax|mobile|dial)$")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Each pattern's spans, leftmost and without overlap in their kind; matches that fail are dropped."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    past = 0
    for m in _DOMAIN.finditer(text):
        a = m.start()
        while a > past and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            found["email"].append((a, m.end()))
            past = m.end()
    found["ip"] = [m.span() for m in _IP.finditer(text) if octets(m[0])]
    for kind, rx, least, most, sound in (("card", _CARD, 13, 19, luhn), ("phone", _PHONE, 9, 15, None)):
        for m in rx.finditer(text):
            digits = "".join(c for c in m[0] if c in "0123456789")
            if least <= len(digits) <= most and (sound is None or sound(digits)):
                found[kind].append(m.span())
    return found


def _shape(s: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "9", s))))


def features(text: str, a: int, b: int, tokens: int, before: str) -> list[str]:
    s = text[a:b]
    digits = "".join(c for c in s if "0" <= c <= "9")
    letters = sum(c.isalpha() for c in s)
    n = len(digits)
    out = ["any", f"digits{min(n, 20) // 2}", f"tokens{tokens}", f"length{min(len(s).bit_length(), 8)}"]
    if not letters and "@" not in s:
        out.append("shape:" + _shape(s))
    if "@" in s:
        out.append("at" + str(bool(re.fullmatch(r"[^\s@]+@[^\s@.]+(?:\.[^\s@.]+)+", s))))
    if re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", s):
        out.append("dotted" + str(octets(s)))
    if not letters and 13 <= n <= 19:
        out.append("check" + str(luhn(digits)))
    if not letters and 9 <= n <= 15:
        out.append(f"dial:{s[0] == '+'}:{any(c in s for c in ' ().-')}")
    if letters and n and tokens == 1 and len(s) >= 16:
        out.append("mixed" + ("hex" if re.fullmatch(r"[0-9a-fA-F]+", s) else "word" if re.fullmatch(r"[A-Za-z0-9_\-+/=]+", s) else "other"))
        out.append(f"mixed{len(s) // 8}")
    elif letters and n:
        out.append("loose")
    if _NAMED.match(before):
        out.append("named")
    if _CALL.match(before):
        out.append("call")
    if a and b < len(text) and text[a - 1] in "\"'`" and text[b] == text[a - 1]:
        out.append("quoted")
    return out


def islands(text: str):
    """Runs of tokens in which some span could lie: (tokens, words before each) per run, in order."""
    run: list[tuple[int, int]] = []
    past: list[tuple[int, int]] = []
    at = 0
    for m in _TRIGGER.finditer(text):
        if m.start() < at:
            continue
        a = m.start()
        while a and not text[a - 1].isspace():
            a -= 1
        b = m.end()
        while b < len(text) and not text[b].isspace():
            b += 1
        at = b
        past.append((a, b))
    for a, b in past:
        near = run and text.count(" ", run[-1][1], a) + text.count("\n", run[-1][1], a) < LONGEST
        if run and not near:
            yield run
            run = []
        if run:
            run += [t.span() for t in _TOKEN.finditer(text, run[-1][1], a)]
        run.append((a, b))
    if run:
        yield run


def _words_before(text: str, at: int, n: int = 2) -> list[str]:
    """The last n words that end before ``at``, in order."""
    out: list[str] = []
    while len(out) < n:
        while at and text[at - 1].isspace():
            at -= 1
        end = at
        while at and not text[at - 1].isspace():
            at -= 1
        if at == end:
            break
        out.append(text[at:end])
    return out[::-1]


def _lattice(text: str, run: list[tuple[int, int]]):
    """(first token, one past the last, start, end, features) of every candidate span of the run."""
    words = [w.strip(_EDGES) for w in _words_before(text, run[0][0])] + [text[a:b].strip(_EDGES) for a, b in run]
    lead = len(words) - len(run)
    for i in range(len(run)):
        back = [w for w in words[max(0, lead + i - 2) : lead + i] if w]
        before = back[-1] if back else ""
        for j in range(i + 1, min(len(run), i + LONGEST) + 1):
            a, b = run[i][0], run[j - 1][1]
            while a < b and text[a] in _EDGES:
                a += 1
            while b > a and text[b - 1] in _EDGES:
                b -= 1
            if a < run[i][1] and b > run[j - 1][0] and _TRIGGER.search(text, a, b):
                yield i, j, a, b, features(text, a, b, j - i, before)


def best(text: str, run: list[tuple[int, int]], weights: dict) -> list[tuple[str, int, int]]:
    score, link = [0.0] + [-math.inf] * len(run), [None] * (len(run) + 1)
    by_start: dict[int, list] = {}
    for i, j, a, b, fs in _lattice(text, run):
        for kind in KINDS:
            by_start.setdefault(i, []).append((j, sum(weights.get((kind, f), 0.0) for f in fs), (kind, a, b)))
    for i in range(len(run)):
        if score[i] > score[i + 1]:
            score[i + 1], link[i + 1] = score[i], (i, None)
        for j, s, span in by_start.get(i, ()):
            if score[i] + s > score[j]:
                score[j], link[j] = score[i] + s, (i, span)
    out, k = [], len(run)
    while k:
        k, span = link[k]
        if span:
            out.append(span)
    return out[::-1]


def examples(n: int, seed: int = 7):
    """(text, spans): sentences of made-up words with personal data and with numbers that are none."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvy") for _ in range(rng.randint(2, 9)))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))

    def card():
        body = rng.choice("3456") + digits(rng.choice((12, 14, 14, 14)))
        full = body + next(c for c in "0123456789" if luhn(body + c))
        return rng.choice((full, full, " ".join(full[k : k + 4] for k in range(0, len(full), 4))))

    def one():
        kind = rng.choice(KINDS + ("none",) * 4)
        if kind == "email":
            return kind, rng.choice((f"{word()}.{word()}{digits(2)}@{word()}.com", f"{word()}@{word()}.{word()}.org", f"{word()}{digits(3)}@{word()}-{word()}.net")), ""
        if kind == "ip":
            return kind, ".".join(str(rng.randint(0, 255)) for _ in range(4)), ""
        if kind == "card":
            return kind, card(), ""
        if kind == "phone":
            d = digits(10)
            return kind, rng.choice((f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}", f"+{digits(2)} {d[:3]} {d[3:6]} {d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"+1{d}")), rng.choice(("", "", "call ", "phone: "))
        if kind == "secret":
            return kind, rng.choice((hexes(40), hexes(32), "sk_" + hexes(24), "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(36)) + "7")), rng.choice(('token = "', "secret: ", "api_key=", "password = "))
        return kind, rng.choice((digits(4), digits(1), digits(6), digits(16), digits(11), f"{digits(2)}.{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(3)}.{digits(3)}.999.{digits(3)}", f"{word()}{digits(2)}", f"{digits(3)}-{digits(3)}", f"§{digits(3)}", f"{digits(2)}:{digits(2)}", f"{digits(3)} {digits(3)}", f"@{word()}", hexes(8))), ""

    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(0, 4))) + " "
            kind, body, lead = one()
            if kind == "none" and re.fullmatch(r"[0-9]{16}", body) and luhn(body):
                kind = "card"
            text += lead
            if kind != "none":
                spans.append((kind, len(text), len(text) + len(body)))
            text += body + ('"' if lead.endswith('"') else "") + rng.choice(("", "", ".", ",", "###", "!!")) + " "
        yield text, spans


@cache
def trained(n: int = EXAMPLES, rounds: int = ROUNDS, rate: float = RATE) -> dict:
    """Weights by gradient steps on the log-likelihood, with forward and backward sums over segmentations."""
    data = []
    for text, spans in examples(n):
        for run in islands(text):
            data.append((len(run), list(_lattice(text, run)), {(a, b): k for k, a, b in spans}))
    w: dict[tuple[str, str], float] = {}
    for r in range(rounds):
        step = rate / (1 + r)
        for size, spans, gold in data:
            scored = [(i, j, k, math.exp(min(30.0, sum(w.get((k, f), 0.0) for f in fs))), fs, gold.get((a, b)) == k) for i, j, a, b, fs in spans for k in KINDS]
            ahead, behind = [1.0] + [0.0] * size, [0.0] * size + [1.0]
            starts: list[list] = [[] for _ in range(size + 1)]
            for x in scored:
                starts[x[0]].append(x)
            for i in range(size):
                ahead[i + 1] += ahead[i]
                for x in starts[i]:
                    ahead[x[1]] += ahead[i] * x[3]
            for i in range(size - 1, -1, -1):
                behind[i] = behind[i + 1] + sum(x[3] * behind[x[1]] for x in starts[i])
            for i, j, k, e, fs, true in scored:
                push = step * (true - ahead[i] * e * behind[j] / ahead[size])
                if abs(push) > 1e-4:
                    for f in fs:
                        w[k, f] = w.get((k, f), 0.0) + push
    return {key: round(v, 4) for key, v in w.items()}


def find(text: str, weights: dict) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """The patterns' spans by kind, and all spans in order of kind and start."""
    if not _TRIGGER.search(text):
        return {k: [] for k in BASE}, []
    fixed = base_spans(text)
    spans = [(k, a, b) for k in BASE for a, b in fixed[k]]
    taken = sorted((a, b) for _, a, b in spans)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    more = []
    for run in islands(text):
        near = taken[bisect_right(reach, run[0][0]) : bisect_left(starts, run[-1][1])]
        more += [x for x in best(text, run, weights) if not any(a < x[2] and x[1] < b for a, b in near)]
    order = {k: n for n, k in enumerate(KINDS)}
    return fixed, sorted(spans + more, key=lambda x: (order[x[0]], x[1], x[2]))


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone and base_sha256 of the patterns, all spans and their number; clashing columns are replaced."""
    weights = trained()

    @F.arrow_udf("struct<n_email: long, n_ip: long, n_card: long, n_phone: long, base_sha256: string, spans: string, n_spans: long>")
    def look(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            fixed, every = find(t.as_py() or "", weights)
            base = _written([(k, a, b) for k in BASE for a, b in fixed[k]])
            rows.append((*(len(fixed[k]) for k in BASE), hashlib.sha256(base.encode()).hexdigest(), _written(every), len(every)))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"]
    out = docs.drop(*names).withColumn("_p", look(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return out.withColumns({n: F.col(f"_p.{n}") for n in names}).drop("_p")
