"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

The base rules (email, ip, card, phone) give spans that always stay. Candidate
spans beside them (values after a credential's name, long mixed tokens, digit
groups, account numbers, addresses written out) are judged by regex, gazetteer
and context labelers that vote personal, not personal, or abstain.
Expectation-maximisation estimates how often each labeler is right on personal
and on other spans, and each kind's share of personal ones, over the spans of
all texts. Base spans anchor it: they are personal beyond doubt, so what a
labeler says about them measures it. Abstaining tells nothing, so kinds can't be
told apart by who is silent. The posteriors train a logistic span classifier on
the spans of a bounded sample and, so that votes the sample lacks count too, on
each single vote a kind can get; it decides about every candidate of every text.

Defined results: a null or empty text has no spans; overlapping candidates give
way to base spans and to candidates that start earlier; a table without spans
leaves the labelers' prior reliabilities; an empty table gives an empty result;
repeated rows are rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, prepare, spread

KINDS = ("email", "ip", "card", "phone", "secret", "number", "account", "address")
BASE = KINDS[:4]
#: Documents that the classifier is fitted on at most.
MAX_DOCS = 4000

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can't start inside a run of digits unless one from its first digit fails too, so runs are tried once.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NAMED = re.compile(r"(?i)\b(?:password|passwd|passwort|contrase\u00f1a|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key|auth)\b\s{0,3}[=:]\s{0,3}[\"']?([^\s\"',;]{4,})")
MIXED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}(?![A-Za-z0-9_-])")
GROUPS = re.compile(r"(?<![0-9A-Za-z+.])(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-][0-9]{2,5})+(?![0-9A-Za-z])")
ACCOUNT = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")
AT = re.compile(r"(?i)\s?[\[(]\s?at\s?[\])]\s?")
HOST = re.compile(r"(?i)[a-z0-9-]+(?:\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[a-z0-9-]+)+")
LETTERS = re.compile(r"[A-Za-z]")
DIGITS = re.compile(r"[0-9]")

# Word lists, by language, and the endings of common host names.
CREDENTIAL_WORDS = frozenset("password passwd passwort kennwort pwd passphrase passcode token secret key apikey api auth bearer credential credentials login pin clave contrase\u00f1a mot passe cl\u00e9 schl\u00fcssel geheim".split())
CONTACT_WORDS = frozenset("phone tel telephone telefon tel\u00e9fono t\u00e9l\u00e9phone mobile cell fax call contact whatsapp sms hotline rufnummer handy m\u00f3vil portable ssn social security sozialversicherung account konto cuenta compte iban bic passport pass passeport pasaporte ausweis personalausweis dni nif steuernummer insurance patient license licence driver email mail correo courriel adresse address dob born".split())
PLAIN_WORDS = frozenset("page pages seite seiten p\u00e1gina version versi\u00f3n chapter kapitel cap\u00edtulo chapitre figure abbildung figura table tabelle tabla year jahr a\u00f1o ann\u00e9e isbn issn doi section abschnitt secci\u00f3n volume band tomo edition issue article order bestellung total price preis score build release rev line lines step item items lot part model commit sha md5 hash checksum digest revision".split())
PLACEHOLDERS = frozenset("example test testing sample dummy changeme placeholder password secret none null true false xxxx yyyy your yours here value string token redacted hidden unknown undefined required optional invalid expired".split())
MONTHS = frozenset("jan feb mar apr may jun jul aug sep oct nov dec january february march april june july august september october november december januar februar m\u00e4rz mai juni juli oktober dezember enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre janvier f\u00e9vrier mars avril juin juillet ao\u00fbt septembre octobre novembre d\u00e9cembre".split())
TOP_LEVEL = frozenset("com org net edu gov mil int info biz name pro io co dev app ai me tv cc eu de fr es uk it nl be at ch dk se no fi pl cz sk hu ro bg gr pt ie is lt lv ee si hr rs ua ru tr il in cn jp kr tw hk sg my th vn id ph au nz za ng ke eg ma br ar mx cl pe us ca".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, each at sign looked at once: no local part holds one, so none can be part of two."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGITS.search(text):  # the other kinds have one
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def spelled(text: str) -> Iterator[tuple[int, int]]:
    """Addresses written with a bracketed "at"; each is looked at once, from where the last one ended."""
    end = 0
    for m in AT.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        host = HOST.match(text, m.end()) if start < m.start() else None
        if host:
            yield start, host.end()
            end = host.end()


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    # each rule is tried where a character that its matches must have occurs
    found = [("secret", *m.span(1)) for m in NAMED.finditer(text)] if "=" in text or ":" in text else []
    if DIGITS.search(text):
        found += [("secret", *m.span()) for m in MIXED.finditer(text) if DIGITS.search(m[0]) and LETTERS.search(m[0])]
        found += [("number", *m.span()) for m in GROUPS.finditer(text)] + [("account", *m.span()) for m in ACCOUNT.finditer(text)]
    if "(" in text or "[" in text:
        found += [("address", a, b) for a, b in spelled(text)]
    if not found:
        return []
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    tops = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    out, end = [], -1
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2], s[0])):
        k = bisect.bisect_left(starts, b)
        if a >= end and not (k and tops[k - 1] > a):
            out.append((kind, a, b))
            end = b
    return out


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def dated(s: str) -> bool:
    """A day, month and year, in any order, or a range of years."""
    n = [int(x) for x in re.findall("[0-9]+", s)]
    if len(n) == 2:
        return all(1000 <= x <= 2199 for x in n)
    return len(n) == 3 and any(1000 <= n[y] <= 2199 and min(n[m], n[d]) >= 1 and min(n[m], n[d]) <= 12 and max(n[m], n[d]) <= 31 for y, m, d in ((0, 1, 2), (2, 0, 1)))


def book_number(s: str) -> bool:
    """A book number of ten or thirteen digits whose check digit fits."""
    d = [int(x) for x in re.findall("[0-9]", s)]
    if len(d) == 13:
        return d[:2] == [9, 7] and d[2] in (8, 9) and sum(x * (3 if k % 2 else 1) for k, x in enumerate(d)) % 10 == 0
    return len(d) == 10 and sum((10 - k) * x for k, x in enumerate(d)) % 11 == 0 and bool(re.fullmatch(r"[0-9]{1,5}[- ][0-9]+[- ][0-9]+[- ][0-9]", s))


def account_fits(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def identifier(s: str) -> bool:
    """Words joined as names in programs are, or a short plain word."""
    parts = re.split("[_-]+", s)
    return s.isalpha() and s.islower() and len(s) < 8 or sum(x.isalpha() and len(x) >= 3 for x in parts) >= 2 and not any(len(x) >= 8 and DIGITS.search(x) for x in parts)


def number_shape(s: str) -> int:
    groups = [len(x) for x in re.findall("[0-9]+", s)]
    if groups == [3, 2, 4] and "-" in s:  # a social security number
        return 1
    if groups in ([3, 3, 4], [3, 4], [4, 3, 3], [2, 4, 4], [3, 3, 3], [2, 2, 2, 2, 2]) and "." not in s.strip("."):
        return 1
    return 0 if 9 <= sum(groups) <= 15 else -1


LABELERS = ("shape", "check", "random", "listed", "placeholder", "plain", "context", "mark")


def votes(text: str, span: tuple[str, int, int]) -> list[int]:
    """1: personal, -1: not, 0: abstains, in the order of LABELERS: three of form, two of word lists, three of context."""
    kind, a, b = span
    s = text[a:b]
    low = s.lower()
    before = re.findall(r"\w+", text[max(0, a - 40) : a].lower())[-3:]
    words = {*before, *re.findall(r"\w+", text[b : b + 25].lower())[:2]}
    both = bool(DIGITS.search(s) and LETTERS.search(s))
    stub = kind in ("secret", "address") and bool(set(re.split(r"[^a-z]+", low)) & PLACEHOLDERS)
    shape = 1 if kind in BASE or kind == "address" else (-1 if stub or identifier(s) or len(s) < 8 and not both else 1 if both and len(s) >= 12 else 0) if kind == "secret" else number_shape(s) if kind == "number" else 0
    check = 1 if kind == "card" else (1 if account_fits(s) else -1) if kind == "account" else (-1 if dated(s) or book_number(s) else 0) if kind == "number" else 0
    random = (-1 if stub or identifier(s) else 1 if len(s) >= 8 and entropy(s) >= 2.6 and not s.isalpha() else 0) if kind == "secret" else 0
    listed = (1 if re.split(r"[^a-z0-9]+", low.rstrip(")]"))[-1] in TOP_LEVEL else -1) if kind in ("email", "address") else 0
    placeholder = -1 if stub and listed < 1 else 0
    plain = -1 if words & PLAIN_WORDS or kind == "number" and words & MONTHS else 0
    context = 1 if (set(before) & CREDENTIAL_WORDS if kind == "secret" else words & CONTACT_WORDS) else 0
    mark = (1 if not context and re.search(r"[=:]\s?[\"']?\Z", text[max(0, a - 3) : a]) else 0) if kind == "secret" else (-1 if re.search(r"(?:[$\u20ac\u00a3#\u00a7]|\bv)\s?\Z", text[max(0, a - 3) : a]) or re.match(r"\s?(?:%|\u20ac|\$)", text[b : b + 2]) else 0) if kind in ("number", "ip") else 0
    return [shape, check, random, listed, placeholder, plain, context, mark]


#: Prior counts of a labeler being right and wrong on a span it votes on, and of a kind's spans being personal and not.
RIGHT, WRONG, SHARE = 40.0, 8.0, 2.0


def odds(table: np.ndarray, share: np.ndarray, hit: np.ndarray, miss: np.ndarray) -> np.ndarray:
    """Log-odds of `personal` for rows of (kind, votes...). hit, miss: each labeler's chance to be right on personal and on other spans it votes on."""
    kind, v = table[:, 0], table[:, 1:]
    out = np.log(share[kind] / (1 - share[kind]))
    out = out + (v == 1) @ np.log(hit / (1 - miss))
    return out + (v == -1) @ np.log((1 - hit) / miss)


def em(table: np.ndarray, times: np.ndarray | None = None, rounds: int = 100) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior of `personal` for each row (kind, votes...), by votes alone, and the model: each kind's share, each labeler's hit and miss. times: how often a row occurs. Base kinds count as personal."""
    table = np.asarray(table, np.int64).reshape(-1, 1 + len(LABELERS))
    times = np.ones(len(table)) if times is None else np.asarray(times, float)
    base = table[:, 0] < len(BASE)
    kinds = len(KINDS)
    model = {"share": np.full(kinds, 0.5), "hit": np.full(len(LABELERS), RIGHT / (RIGHT + WRONG)), "miss": np.full(len(LABELERS), RIGHT / (RIGHT + WRONG))}
    post = 1 / (1 + np.exp(-odds(table, **model)))
    for _ in range(rounds):
        yes = times * np.where(base, 1.0, post)
        no = times - yes
        share = (np.bincount(table[:, 0], yes, kinds) + SHARE) / (np.bincount(table[:, 0], times, kinds) + 2 * SHARE)
        up, down = table[:, 1:] == 1, table[:, 1:] == -1
        hit = (yes @ up + RIGHT) / (yes @ (up | down) + RIGHT + WRONG)
        miss = (no @ down + RIGHT) / (no @ (up | down) + RIGHT + WRONG)
        # a labeler is never taken to be worse than chance, so the two classes can't change places
        model = {"share": np.clip(share, 0.02, 0.98), "hit": np.clip(hit, 0.5, 0.999), "miss": np.clip(miss, 0.5, 0.999)}
        new = 1 / (1 + np.exp(-np.clip(odds(table, **model), -30, 30)))
        moved = np.abs(new - post).max(initial=0)
        post = new
        if moved < 1e-6:
            break
    return post, model


def features(text: str, span: tuple[str, int, int], vote: list[int]) -> list[float]:
    s = text[span[1] : span[2]]
    return shaped(KINDS.index(span[0]), vote, [sum(c.isdigit() for c in s) / len(s) - 0.5, (math.log1p(len(s)) - 2.5) / 2, entropy(s) / 4 - 0.75])


def shaped(kind: int, vote: list[int], form: list[float]) -> list[float]:
    return [1.0, *(float(k == kind) for k in range(len(KINDS))), *(float(v == 1) for v in vote), *(float(v == -1) for v in vote), *form]


def single_votes() -> np.ndarray:
    """(kind, votes...) of a span on which all labelers are silent, or all but one, or all but two."""
    rows, n = [], len(LABELERS)
    for kind in range(len(KINDS)):
        rows.append([kind] + [0] * n)
        for j in range(n):
            for v in (-1, 1):
                rows.append([kind, *(v if i == j else 0 for i in range(n))])
                rows += [[kind, *(v if i == j else w if i == k else 0 for i in range(n))] for k in range(j) for w in (-1, 1)]
    return np.array(rows)


def train(x: np.ndarray, p: np.ndarray, weight: np.ndarray | None = None, l2: float = 0.1) -> np.ndarray:
    """Logistic regression on soft labels, by Newton's method."""
    w = np.zeros(x.shape[1])
    weight = np.ones(len(x)) if weight is None else weight
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (weight * (p - q)) - l2 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def judged(text: str | None) -> Iterator[tuple[tuple[str, int, int], list[int]]]:
    """Base spans and candidates of a text with their votes."""
    if text:
        base = base_spans(text)
        for s in [*base, *candidates(text, base)]:
            yield s, votes(text, s)


def vote_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of (kind, votes...) over all documents, in order, and how often each occurs: all that EM needs, and at most as many rows as there are kinds times votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            seen.update((KINDS.index(s[0]), *v) for text in b.column(0).to_pylist() for s, v in judged(text))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], ["v", "n"])

    counts = only(spread(docs), "text").mapInArrow(run, "v array<int>, n long").groupBy("v").agg(F.sum("n").alias("n"))
    rows = sorted((tuple(r[0]), r[1]) for r in counts.collect())
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64)


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, seed: int = 5) -> np.ndarray:
    """Weights of the span classifier: EM over the votes of all documents, then training on those of the smallest seeded hash of their ids."""
    prepare(docs.sparkSession)
    model = em(*vote_counts(docs))[1]
    few = only(docs, "doc_id").where("doc_id is not null").withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(seed))).orderBy("h").limit(max_docs).select("doc_id").distinct()
    df = only(docs.join(F.broadcast(few), "doc_id", "left_semi"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [([KINDS.index(s[0]), *v], features(text, s, v)) for text in b.column(0).to_pylist() for s, v in judged(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["v", "x"])

    return classifier(sorted((tuple(r[0]), tuple(r[1])) for r in df.mapInArrow(run, "v array<int>, x array<double>").collect()), model)


def classifier(rows: list[tuple], model: dict[str, np.ndarray]) -> np.ndarray:
    """Weights from rows of ((kind, votes...), features), each kind with the same weight, and from single votes."""
    alone = single_votes()
    x = [shaped(int(r[0]), r[1:].tolist(), [0.0, 0.0, 0.0]) for r in alone]
    weight = np.ones(len(alone))
    if rows:
        kind = np.array([r[0][0] for r in rows])
        weight = np.concatenate([weight, (100 / np.maximum(100, np.bincount(kind, minlength=len(KINDS))))[kind]])
        alone = np.vstack([alone, [r[0] for r in rows]])
        x += [list(r[1]) for r in rows]
    return train(np.array(x), 1 / (1 + np.exp(-odds(alone, **model))), weight)


def all_spans(text: str | None, weights: np.ndarray) -> tuple[list, list]:
    """Base spans, and all spans, each sorted by kind as listed and start."""
    if not text:
        return [], []
    order = lambda s: (KINDS.index(s[0]), s[1])
    base = sorted(base_spans(text), key=order)
    more = [s for s in candidates(text, base) if np.dot(features(text, s, votes(text, s)), weights) >= 0]
    return base, sorted(base + more, key=order)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans and n_spans (of all) for every row of docs."""
    weights = fit(docs, max_docs)
    df = only(spread(docs), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [all_spans(t, weights) for t in b.column(1).to_pylist()]
            counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in BASE]
            sha = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array([joined(x) for _, x in found], pa.string()), pa.array([len(x) for _, x in found], pa.int64())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"])

    return df.mapInArrow(run, f"doc_id {df.dtypes[0][1]}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
