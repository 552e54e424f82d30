"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Candidates are the base spans and what cheap patterns, a gazetteer of first names
and context words propose beside them: names, identity numbers, secrets (long
runs of letters and digits, values named token, key or password), addresses and
numbers in other shapes. Three kinds of labelers vote on each:
regular expressions, gazetteers and context words; they vote for, against, or
abstain. Over all candidates of the corpus the votes are counted by pattern (a
small table), and expectation-maximisation estimates, for each kind of span, each
labeler's reliability and the share of true spans without any labels. The posteriors train a final
logistic span classifier on the features of all candidates, counted by (kind,
votes, features): features are steps, so their distinct vectors are bounded
whatever the corpus. What it accepts is added to the base spans, which always stay.

Edge cases: null text counts as empty; base spans of different kinds may
overlap, an added span never overlaps a base one of its kind; a corpus
without candidates gets no spans; repeated rows stay; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready, stored

KINDS = ("email", "ip", "card", "phone", "name", "id", "secret")
BASE = KINDS[:4]

# The base patterns of the contract.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# (It can only begin at the start of a run of digits: said so, long runs stay linear.)
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Gazetteers and context words (fixed values).
FIRST_NAMES = frozenset("james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah anna peter paul laura maria jean pierre marie hans klaus jose juan carlos ana".split())
TITLES = frozenset("mr mrs ms dr prof herr frau monsieur madame mme señor señora sr sra".split())
FOR = {
    "email": frozenset("mail email e-mail contact write address reply courriel correo".split()),
    "phone": frozenset("phone tel call mobile fax telephone telefon téléphone teléfono cell".split()),
    "card": frozenset("card visa mastercard credit debit payment karte carte tarjeta".split()),
    "ip": frozenset("ip server host address login from".split()),
    "name": frozenset("named dear regards sincerely signed contact by".split()),
    "id": frozenset("ssn passport id identity social security number ausweis".split()),
    "secret": frozenset("token key apikey api-key secret password passwd pwd passphrase auth bearer credential credentials".split()),
}
AGAINST = frozenset("version page chapter figure table section total price order isbn part model".split())
#: Calling codes and first digits of card issuers.
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 380 420".split())
_ISSUER = re.compile(r"4|5[1-5]|2[2-7]|3[4-7]|6")
#: Proposed beside the base spans; what a group holds is the span, else the match.
CANDIDATES = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*(?: ?\[at\] ?| ?\(at\) ?| at )[A-Za-z0-9-]+(?:(?: ?\[dot\] ?| ?\(dot\) ?| dot |\.)[A-Za-z]{2,})+"),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]| dot |\.)[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{4}([ .-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ .-])[0-9]{6}\2[0-9]{5})(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])"),
    "id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "name": re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señora?)\.? [A-ZÀ-Þ][a-zà-ÿ]+(?: [A-ZÀ-Þ][a-zà-ÿ]+)?"),
}
_SURNAMES = r"(?:[-' ][A-ZÀ-Þ][a-zà-ÿ]+){1,2}"
#: Names without a title: a first name of the gazetteer and a surname; two capitalised words after a context word.
_FIRST = re.compile("(?:" + "|".join(sorted(n.capitalize() for n in FIRST_NAMES)) + ")" + _SURNAMES)
_SAID = re.compile(r"(?:[Nn]amed|[Dd]ear|[Rr]egards|[Ss]incerely|[Ss]igned|[Cc]ontact|[Bb]y)\b[,:]?\s+([A-ZÀ-Þ][a-zà-ÿ]+" + _SURNAMES + ")")
#: What a text must hold for the pattern to be tried at all.
HINTS = {"email": re.compile(r"\bat\b|\[at|\(at"), "ip": re.compile(r"[0-9](?:\[|\(|\.| dot )"), "card": re.compile(r"[0-9]{4}[ .-]?[0-9]{4}"), "phone": re.compile(r"[0-9]{3}[-. ][0-9]{4}"), "id": re.compile(r"[0-9]-[0-9]{2}-"), "name": re.compile(r"Mr|Ms|Dr\b|Dr\.|Prof|Herr|Frau|Monsieur|Madame|Señor")}
#: Runs that may be keys, and values after = or : whose name says so.
_RUN = re.compile(r"[A-Za-z0-9+_]{20,}")
_VALUE = re.compile(r"[=:]\s{0,3}[\"']?([A-Za-z0-9+/_.-]{8,})")
#: How known kinds of keys begin, and the lengths of digests in hexadecimal (fixed values).
_KNOWN_KEY = re.compile(r"AKIA|ASIA|AIza|gh[opsu]_|glpat|sk_|pk_|xox[abprs]|eyJ")
_HEX_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
_TOKEN = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
N_LABELERS = 3
CONTEXT = 40

Span = tuple[str, int, int]


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, free := m.end()))
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _ok_card(span: str) -> bool:
    digits = span.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[Span]:
    """The contract's spans by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if any(d in text for d in "0123456789"):
        ips = [m.span() for m in _IP.finditer(text)] if "." in text else []
        out += [("ip", a, b) for a, b in ips if all(len(q := p.lstrip("0") or "0") <= 3 and int(q) <= 255 for p in text[a:b].split("."))]
        out += [("card", a, b) for a, b in (m.span() for m in _CARD.finditer(text)) if b - a >= 13 and _ok_card(text[a:b])]
        phones = [m.span() for m in _PHONE.finditer(text)] if "+" in text else []
        out += [("phone", a, b) for a, b in phones if 9 <= sum("0" <= c <= "9" for c in text[a:b]) <= 15]
    return out


def _context(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    return _TOKEN.findall(text[max(0, a - CONTEXT) : a].lower())[-5:], _TOKEN.findall(text[b : b + CONTEXT].lower())[:5]


def _entropy(span: str) -> float:
    """Bits a character."""
    return -sum(n / len(span) * log2(n / len(span)) for n in Counter(span).values())


def votes(kind: str, text: str, a: int, b: int) -> tuple[int, ...]:
    """Each labeler's vote: 1 for, 0 against, -1 abstains."""
    span, (left, right) = text[a:b], _context(text, a, b)
    parts = _TOKEN.findall(span.lower())
    digits = "".join(c for c in span if "0" <= c <= "9")
    if kind == "email":
        shape = "@" in span and len(parts[-1]) > 1 and parts[-1].isalpha() or "[at]" in span or "(at)" in span or "dot" in span
        known = 1 if parts[-1] in ("com", "org", "net", "edu", "de", "fr", "es") else -1
    elif kind == "ip":
        octets = re.findall("[0-9]+", span)
        shape = all(o == "0" or o[0] != "0" for o in octets)
        known = int(0 < int(octets[0]) < 224)
    elif kind == "card":
        shape = len(digits) in (15, 16) and len({c for c in span if c not in digits}) < 2
        known = int(bool(_ISSUER.match(digits)))
    elif kind == "phone":
        shape = span[0] == "(" or span.count("-") == 2 or span[0] == "+" and not span[1:].isdigit()
        known = int(any(digits[:k] in CALLING for k in (1, 2, 3))) if span[0] == "+" else -1
    elif kind == "secret":
        shape = any(c.isdigit() for c in span) and any(c.isalpha() for c in span) and _entropy(span) >= 3
        known = 1 if _KNOWN_KEY.match(span) or len(span) in _HEX_LENGTHS and not span.strip("0123456789abcdefABCDEF") else -1
    elif kind == "id":
        shape, known = span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00", -1
    else:
        shape, known = " " in span, int(any(p in FIRST_NAMES or p in TITLES for w in parts for p in (w, *w.split("-"))))
    near = set(left) | set(right)
    by_context = 1 if near & FOR[kind] else (0 if near & AGAINST else -1)
    return int(shape), known, by_context


def features(kind: str, text: str, a: int, b: int) -> list[float]:
    span, (left, right) = text[a:b], _context(text, a, b)
    v = votes(kind, text, a, b)
    near = set(left) | set(right)
    digits = sum(c.isdigit() for c in span)
    steps = [min(3, len(near & FOR[kind])) / 2, min(3, len(near & AGAINST)) / 2, round(10 * digits / max(1, len(span))) / 10, min(len(span), 60) // 5 / 12]
    row = [1.0, *(float(kind == k) for k in KINDS), *(float(x == 1) for x in v), *(float(x == 0) for x in v)]
    return [*row, *steps, float(a == 0 or text[a - 1].isspace())]


def _proposed(text: str) -> Iterator[Span]:
    for kind, pattern in CANDIDATES.items():
        if HINTS[kind].search(text):
            for m in pattern.finditer(text):
                if kind == "ip" and any(int(o) > 255 for o in re.findall("[0-9]+", m[0])) or kind == "card" and not luhn("".join(c for c in m[0] if c.isdigit())):
                    continue
                yield kind, m.start(), m.end()
    for m in _RUN.finditer(text):
        if not m[0].isdigit() and any(c.isdigit() for c in m[0]):
            yield "secret", *m.span()
    for m in _VALUE.finditer(text):
        named = _TOKEN.findall(text[max(0, m.start() - CONTEXT) : m.start()].lower())[-1:]
        if named and not FOR["secret"].isdisjoint((named[0], *named[0].split("-"))) and not m[1].isalpha():
            yield "secret", *m.span(1)
    for pattern, group in ((_FIRST, 0), (_SAID, 1)):
        for m in pattern.finditer(text):
            if m.start() == 0 or not text[m.start() - 1].isalnum():
                yield "name", *m.span(group)


def _free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a:b touches none of ``taken``, which are sorted and apart."""
    at = bisect_left(taken, (a, b))
    return (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0])


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Spans the labelers vote on: the base spans first, then those proposed
    that touch no candidate of their kind."""
    out = {kind: [(a, b) for k, a, b in base if k == kind] for kind in KINDS}
    for kind, a, b in _proposed(text):
        if all(_free(out[k], a, b) for k in ((kind, "phone", "card") if kind == "id" else (kind,))):
            insort(out[kind], (a, b))
    own = set(base)
    return base + [s for kind in KINDS for a, b in out[kind] if (s := (kind, a, b)) not in own]


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over vote patterns and their counts: the share of true spans, and each
    labeler's probability of voting for true and for false spans."""
    v = np.array([p for p, _ in patterns], dtype=np.int64).reshape(-1, N_LABELERS)
    n = np.array([c for _, c in patterns], dtype=np.float64)
    share, hit, miss = 0.5, np.full(N_LABELERS, 0.8), np.full(N_LABELERS, 0.2)
    for _ in range(rounds if len(n) else 0):
        q = posterior(v, share, hit, miss)
        share = float(np.clip((n * q).sum() / n.sum(), 0.02, 0.98))
        for j in range(N_LABELERS):
            said = v[:, j] >= 0
            for p, weight in ((hit, n * q), (miss, n * (1 - q))):
                p[j] = (weight[v[:, j] == 1].sum() + 2 * (0.8 if p is hit else 0.2)) / (weight[said].sum() + 2)
    return share, hit, miss


def posterior(v: np.ndarray, share: float, hit: np.ndarray, miss: np.ndarray) -> np.ndarray:
    def likely(p: np.ndarray) -> np.ndarray:
        return np.where(v == 1, np.log(np.clip(p, 1e-3, 1 - 1e-3)), np.where(v == 0, np.log(1 - np.clip(p, 1e-3, 1 - 1e-3)), 0)).sum(axis=1)

    z = np.log(share / (1 - share)) + likely(hit) - likely(miss)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_classifier(x: np.ndarray, q: np.ndarray, n: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression on soft labels by gradient steps; row i stands for ``n[i]`` candidates."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        w -= 1.0 * (x.T @ (n * (p - q)) / n.sum() + 1e-4 * w)
    return w


_SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<string>, cand array<struct<kind:string,start:int,end:int,base:boolean,votes:string,x:array<float>>>"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cand = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("x", pa.list_(pa.float32()))]))
    for batch in batches:
        counts, shas, bases, cands = [[], [], [], []], [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            for k, kind in enumerate(BASE):
                counts[k].append(sum(s[0] == kind for s in base))
            bases.append(said := [f"{k}:{a}:{b}" for k, a, b in base])
            shas.append(hashlib.sha256(",".join(said).encode()).hexdigest())
            cands.append([{"kind": k, "start": a, "end": b, "base": i < len(base), "votes": ",".join(map(str, votes(k, text, a, b))), "x": features(k, text, a, b)} for i, (k, a, b) in enumerate(candidates(text, base))])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas), pa.array(bases, pa.list_(pa.string())), pa.array(cands, cand)],
            ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "cand"],
        )


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans, n_added, n_spans (base and added), n_secret."""
    python_ready(docs.sparkSession)
    seen = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_found, _SPANS), "spans")
    each = seen.select(F.explode("cand").alias("c")).select("c.*")
    # All candidates, counted by what the fit sees of them: few rows, however many candidates.
    counted = sorted((r["kind"], r["votes"], r["x"], r["count"]) for r in each.groupBy("kind", "votes", "x").count().collect())
    v = np.array([list(map(int, s.split(","))) for _, s, _, _ in counted], dtype=np.int64).reshape(-1, N_LABELERS)
    n = np.array([c for *_, c in counted], dtype=np.float64)
    q = np.zeros(len(counted))
    for kind in {k for k, *_ in counted}:  # a labeler may be good at one kind and poor at another
        own = np.array([k == kind for k, *_ in counted])
        q[own] = posterior(v[own], *estimate(list(zip(map(tuple, v[own].tolist()), n[own]))))
    w = fit_classifier(np.array([x for _, _, x, _ in counted], dtype=np.float64), q, n) if counted else np.zeros(1)
    weights = "array(" + ",".join(f"{q!r}D" for q in map(float, w)) + ")"
    accepted = F.expr(f"transform(filter(cand, c -> NOT c.base AND aggregate(zip_with(c.x, {weights}, (a, b) -> a * b), 0D, (s, t) -> s + t) > 0D), c -> struct(array_position(array({','.join(repr(k) for k in KINDS)}), c.kind) AS k, c.start AS s, concat(c.kind, ':', c.start, ':', c.end) AS t))")
    based = F.expr(f"transform(base, b -> struct(array_position(array({','.join(repr(k) for k in KINDS)}), split_part(b, ':', 1)) AS k, int(split_part(b, ':', 2)) AS s, b AS t))")
    spans = F.array_join(F.transform(F.array_sort(F.concat(based, accepted)), lambda s: s["t"]), ",")
    return seen.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), F.size(accepted).cast("long").alias("n_added"), (F.size("base") + F.size(accepted)).cast("long").alias("n_spans"), F.size(F.filter(accepted, lambda a: a["t"].startswith("secret:"))).cast("long").alias("n_secret"))
