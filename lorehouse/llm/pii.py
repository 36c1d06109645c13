"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, in_arrow, plus

#: The kinds with base patterns, and one that the method alone finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LABELERS = ("format", "check", "gazetteer", "context", "border")
#: Probability from which the classifier adds a span to the base ones.
ACCEPT = 0.9

_ANY = re.compile(r"[0-9@]|[\[(]at[\])]", re.I)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs of digits are entered at their first digit only; a match from a later one would need the same that failed there.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r" ?(?:\[at\]|\(at\)) ?", re.I)
_DOTTED = re.compile(r"[A-Za-z0-9-]+(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]+)+", re.I)
_IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_CARD4 = re.compile(r"(?<![0-9])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,}+")
_ASSIGNED = re.compile(r"""[:=]\s?["']?\Z""")
_PHONE10 = re.compile(r"(?<![0-9+.()-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")

#: Words before a span that speak for its kind, and words that speak against any.
_CUES = {
    "email": frozenset("mail email e-mail write contact correo courriel schreiben escribe".split()),
    "ip": frozenset("ip address host server client login adresse dirección servidor".split()),
    "card": frozenset("card visa mastercard credit debit payment karte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call mobile fax telefon téléphone teléfono rufen llame".split()),
    "secret": frozenset("token key secret password passwd pwd bearer auth credential apikey api_key passwort clave".split()),
}
_AGAINST = frozenset("version release isbn issn order invoice section chapter build serial article sku commit revision checksum hash uuid digest".split())
_WORDS = re.compile(r"[^\W\d_][\w-]*")
_TOP_DOMAINS = frozenset("com net org edu gov int info biz io de fr es uk eu it nl ch at be pl us ca au jp cn in br ru".split())
_PREFIXES = ("AKIA", "AIza", "ghp_", "gho_", "sk-", "sk_", "xoxb-", "xoxp-", "eyJ")
_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "62", "65")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> list[int] | None:
    parts = [p.lstrip("0") for p in s.split(".")]
    return None if any(len(p) > 3 for p in parts) else [int(p or "0") for p in parts]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns: leftmost, not overlapping within a kind, in time linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((0, start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if (p := _octets(m[0])) and max(p) <= 255]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def near_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Other forms of the kinds, and near misses of the base patterns, that touch no base span of any kind."""
    out, done = [], 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        tail = _DOTTED.match(text, m.end()) if start < m.start() else None
        if tail:
            out.append((0, start, tail.end()))
            done = tail.end()
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text)]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(_digits(m[0])) <= 19]
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 7 <= len(_digits(m[0])) <= 18]
    for kind, pattern in ((1, _IP6), (2, _CARD4), (3, _PHONE10), (4, _SECRET)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    ends = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return i == 0 or ends[i - 1] <= a

    return sorted({s for s in out if free(s[1], s[2])})


def votes(text: str, kind: int, start: int, end: int) -> str:
    """One character a labeler, in the order of LABELERS: 1 for, 0 against, ? no opinion.

    format: whether the span is written as its kind mostly is; check: a rule of the kind that its parts must meet;
    gazetteer: known endings and prefixes; context: cue words before it; border: no letter or digit beside it.
    """
    name, span = KINDS[kind], text[start:end]
    digits = _digits(span)
    form, check, known = "1", "?", "?"
    if name == "email":
        form = "1" if "@" in span else "?"
        tail = re.split(r"[.\])]\s?", span)[-1].lower()
        known = "1" if tail in _TOP_DOMAINS else "0"
        check = "0" if span[0] in ".-" or ".." in span else "1"
    elif name == "ip":
        parts = _octets(span) if "." in span else []
        check = "1" if parts is not None and max(parts, default=0) <= 255 else "0"
        known = "0" if parts is None or parts and (parts[0] == 0 or max(parts) >= 255 or parts == [127, 0, 0, 1]) else "1"
        form = "0" if text[max(0, start - 1) : start] == "." or text[end : end + 1] == "." and text[end + 1 : end + 2].isdigit() else "1"
    elif name == "card":
        groups = re.split("[^0-9]", span)
        form = "1" if len(groups) in (3, 4) and max(map(len, groups)) <= 6 else "?" if len(groups) == 1 else "0"
        check = "1" if 13 <= len(digits) <= 19 and luhn(digits) else "0"
        known = "1" if digits.startswith(_ISSUERS) else "0"
    elif name == "phone":
        form = "1" if span[0] in "+(" else "?"
        check = "1" if 9 <= len(digits) <= 15 else "0"
        known = "0" if digits[0] == "0" or len(set(digits)) < 3 else "1" if span[0] == "+" else "?"
    else:
        form = "1" if _ASSIGNED.search(text, max(0, start - 3), start) else "0"
        check = "1" if len(re.findall("[0-9]+|[A-Za-z]+", span)) >= 6 else "0"
        known = "1" if span.startswith(_PREFIXES) or len(span) in (32, 40, 64) and _HEX.match(span) else "?"
    before = [w.lower() for w in _WORDS.findall(text, max(0, start - 40), start)[-4:]]
    context = "1" if any(w in _CUES[name] for w in before) else "0" if any(w in _AGAINST for w in before) else "?"
    inside = (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    return form + check + known + context + ("0" if inside else "1")


def _side(text: str, at: int) -> int:
    if not 0 <= at < len(text):
        return 0
    c = text[at]
    return 1 if c.isspace() else 2 if c.isalnum() else 3


def candidates(text: str) -> list[tuple[int, int, int, bool, str, int]]:
    """(kind, start, end, base, votes, shape) of a text; shape is one of 128 kinds of neighbours and length."""
    if not _ANY.search(text):
        return []
    base = base_spans(text)
    out = []
    for strict, spans in ((True, base), (False, near_spans(text, base))):
        for k, a, b in spans:
            out.append((k, a, b, strict, votes(text, k, a, b), (_side(text, a - 1) * 4 + _side(text, b)) * 8 + min(7, (b - a) // 6)))
    return out


def reliabilities(counts: dict[str, float], rounds: int = 100) -> tuple[float, np.ndarray, dict[str, float]]:
    """Expectation-maximisation over vote patterns of one kind, labelers independent given the truth.

    Returns the prior, P(vote | truth) as [truth, labeler, vote], and each pattern's probability of being true.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    index = np.array([["10?".index(c) for c in p] for p in patterns])
    held = np.zeros((2, len(LABELERS), 3))
    held[1], held[0] = (0.6, 0.1, 0.3), (0.1, 0.6, 0.3)
    prior, places = 0.5, np.arange(len(LABELERS))
    for _ in range(rounds):
        like = [np.log(held[z][places, index]).sum(axis=1) + np.log(prior if z else 1 - prior) for z in (0, 1)]
        true = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
        prior = (float((n * true).sum()) + 1) / (float(n.sum()) + 2)
        for z, share in ((0, 1 - true), (1, true)):
            for v in range(3):
                # a prior of a few votes keeps labelers better than chance where data are few
                held[z, :, v] = ((n * share)[:, None] * (index == v)).sum(axis=0) + (6, 1, 3)[v if z or v == 2 else 1 - v]
            held[z] /= held[z].sum(axis=1, keepdims=True)
    return prior, held, dict(zip(patterns, true.tolist(), strict=True))


#: Features of a kind: one, two a labeler, the sides' kinds, the length.
_WIDTH = 1 + 2 * len(LABELERS) + 4 + 4 + 1


def _features(kind: int, pattern: str, shape: int) -> np.ndarray:
    """Each kind has features of its own, as labelers are not equally good at all."""
    out = np.zeros((len(KINDS), _WIDTH))
    mine = out[kind]
    mine[0] = 1
    for i, c in enumerate(pattern):
        if c != "?":
            mine[1 + 2 * i + (c == "0")] = 1
    mine[11 + shape // 32] = 1
    mine[15 + shape // 8 % 4] = 1
    mine[19] = shape % 8 / 8
    return out.ravel()


def train(docs: DataFrame, text_col: str = "text") -> list[float]:
    """The span classifier's weights: a logistic regression on the truth that the labelers' votes give.

    All documents are read; each task counts its candidates by kind, votes and shape, a table of fixed bounds
    (5 * 3 ** 5 * 128), and only sums of these counts reach the driver. Without candidates the weights are 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[int, str, int]] = Counter()
        for batch in chunks(batches, text_col):
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update((k, v, shape) for k, _, _, _, v, shape in candidates(text))
        rows = [(*key, n) for key, n in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int32(), pa.int64()))], ["kind", "votes", "shape", "n"])

    sums = in_arrow(docs.select(text_col), run, "kind int, votes string, shape int, n long").groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n")).collect()
    rows = sorted((r["kind"], r["votes"], r["shape"], r["n"]) for r in sums)
    truth = {}
    for kind in {r[0] for r in rows}:
        by_pattern: Counter[str] = Counter()
        for k, v, _, n in rows:
            if k == kind:
                by_pattern[v] += n
        truth[kind] = reliabilities(by_pattern)[2]
    x = np.array([_features(k, v, s) for k, v, s, _ in rows]).reshape(len(rows), len(KINDS) * _WIDTH)
    y, n = np.array([truth[k][v] for k, v, _, _ in rows]), np.array([float(r[3]) for r in rows])
    w = np.zeros(x.shape[1])
    for _ in range(50 if rows else 0):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + 0.1 * w
        step = np.linalg.solve(x.T @ ((n * p * (1 - p) + 1e-9)[:, None] * x) + 0.1 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return [round(float(v), 9) for v in w]


def _probability(kind: int, pattern: str, shape: int, weights: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(_features(kind, pattern, shape) @ weights, -30, 30))))


def spans(text: str, weights: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) by kind and start: all base spans, and others that the classifier accepts and that don't overlap within their kind."""
    out, end = [], {}
    for k, a, b, base, v, shape in candidates(text):
        if not base:
            if a < end.get(k, 0) or _probability(k, v, shape, weights) < ACCEPT:
                continue
            end[k] = b
        out.append((k, a, b, base))
    return sorted(out)


_SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find(docs: DataFrame, weights: list[float], text_col: str = "text") -> DataFrame:
    """Add pii, an array of (kind, start, end, base) by kind as in KINDS, then start; code points, end exclusive.

    A null or empty text has none; whole texts of any length are searched in linear time; repeated rows each get
    theirs; a column named pii is replaced.
    """
    docs = docs.drop("pii")
    names = docs.columns
    place, w = names.index(text_col), np.array(weights)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, names[place]):
            found = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in spans(t, w)] if t else [] for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*names, "pii"])

    return in_arrow(docs, run, plus(docs, pii=_SPANS))


def redact(docs: DataFrame, weights: list[float], text_col: str = "text") -> DataFrame:
    """Put [kind] in place of every span; overlapping spans of several kinds give one mark, of the kind that starts first.

    Null and empty texts stay as they are, rows alike stay alike, other columns stay; an empty table gives an empty one.
    """
    names = docs.columns
    place, w = names.index(text_col), np.array(weights)

    def clean(text: str | None) -> str | None:
        found = sorted((a, -b, k) for k, a, b, _ in spans(text, w)) if text else []
        if not found:
            return text
        out, at = [], 0
        for a, b, k in found:
            if a >= at:
                out += [text[at:a], f"[{KINDS[k]}]"]
            at = max(at, -b)
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, names[place]):
            columns = list(batch.columns)
            columns[place] = pa.array([clean(t) for t in columns[place].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return in_arrow(docs, run, docs.schema)


def joined(array: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
