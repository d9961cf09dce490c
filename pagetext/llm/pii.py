"""Personal data by weak supervision.

Base spans are fixed: per kind the leftmost non-overlapping matches of its
pattern that pass its check (ip parts at most 255; card 13 to 19 digits and
Luhn; phone 9 to 15 digits); a failing match is dropped without retry. Base
spans always stay.

The method adds spans. Wider patterns propose candidates; six labelers vote on
each (1 personal, 0 not, -1 no opinion): strict pattern, arithmetic check,
gazetteer (top-level domains, calling codes, card issuers, address ranges),
cue words before the span, shape of the separators, clean borders.
Expectation-maximisation (Dawid and Skene 1979) over the counts of vote
patterns estimates each labeler's reliability per kind; a logistic span
classifier is trained on the resulting probabilities, and a candidate that
reaches ``THRESHOLD`` and touches no base span is added; of added ones that
overlap, the more probable stays.

Counts cover all documents. The driver gets at most 4 * 3^6 * 2^3 pattern
counts, however large the input. Texts are read once, whole; the candidates
are stored and scored from there. A null text is empty; empty tables give no
rows; repeated rows give equal rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import chunks
from .tables import stored

# Kinds in output order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match always begins with a run of digits and no run gives digits back: each run is tried once
BASE_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
BASE_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
BASE_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

# Wider patterns that propose candidates.
SPELT_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+", re.I)
IP_SIX = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
SPELT_AT = re.compile(r"\(at\)|\[at\]", re.I)
LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])")

# Gazetteers: fixed values.
TOP_LEVEL = frozenset("com org net edu gov int info biz io co me uk de fr es it nl ru cn jp br in au ca ch at be pl se no fi dk id eu us".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54",
           "55", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "98")
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "62", "65")
CUES = (re.compile(r"\b(?:e-?mail|mail|contact|write|correo|adresse)\b", re.I), re.compile(r"\b(?:ip|host|server|address|addr|login)\b", re.I),
        re.compile(r"\b(?:card|visa|mastercard|credit|karte|carte|tarjeta)\b", re.I),
        re.compile(r"\b(?:tel|phone|call|fax|mobile|telefon|teléfono|téléphone)\b", re.I))
CUE_REACH = 32
LABELERS = 6
THRESHOLD = 0.9


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def email_matches(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, has a dotted domain) per @; matches as the base pattern has them,
    found from the @ backwards so that long runs stay linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end(), True
            done = m.end()
        elif start < at:
            end = at + 1
            while end < len(text) and (text[end].isascii() and text[end].isalnum()):
                end += 1
            if end > at + 1:
                yield start, end, False
        at = text.find("@", max(at + 1, done))


def passes(kind: int, found: str) -> bool:
    """The arithmetic check of a kind."""
    d = digits(found)
    if kind == EMAIL:
        return "." in found.rpartition("@")[2]
    if kind == IP:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split(".")) if "." in found else True
    return 13 <= len(d) <= 19 and luhn(d) if kind == CARD else 9 <= len(d) <= 15


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, further candidates), each (kind, start, end); candidates may overlap each other."""
    base, more = [], []
    if "@" in text:
        for start, end, dotted in email_matches(text):
            (base if dotted else more).append((EMAIL, start, end))
    if SPELT_AT.search(text):
        more += [(EMAIL, m.start(), m.end()) for m in SPELT_EMAIL.finditer(text)]
    if text.count(":") >= 7:
        more += [(IP, m.start(), m.end()) for m in IP_SIX.finditer(text)]
    if DIGIT.search(text):
        for kind, pattern in ((IP, BASE_IP), (CARD, BASE_CARD), (PHONE, BASE_PHONE)):
            if kind == PHONE and "+" not in text:
                continue
            for m in pattern.finditer(text):
                ok = passes(kind, m.group())
                if ok:
                    base.append((kind, m.start(), m.end()))
                elif kind != CARD or m.end() - m.start() >= 13:
                    more.append((kind, m.start(), m.end()))
        more += [(PHONE, m.start(), m.end()) for m in LOCAL_PHONE.finditer(text)]
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    reach = np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0, int)

    def free(s: int, e: int) -> bool:
        i = int(np.searchsorted(starts, e))     # base spans that begin before e
        return i == 0 or reach[i - 1] <= s
    return sorted(base), sorted(c for c in set(more) if free(*c[1:]))


def votes(text: str, kind: int, start: int, end: int, strict: bool) -> tuple[int, int]:
    """(the six votes in base 3, three shape bits) of a span."""
    found = text[start:end]
    d = digits(found)
    if kind == EMAIL:
        known = int(found.rpartition(".")[2].strip().lower() in TOP_LEVEL) if "." in found else -1
        shape = int(".." not in found and found[0] not in ".-")
    elif kind == IP:
        first = found.split(".")[0].lstrip("0") if "." in found else ""
        known = int(0 < int(first) < 224) if len(first) in (1, 2, 3) else -1
        shape = int(found.count(".") == 3 and not re.search(r"\b0[0-9]", found))
    elif kind == CARD:
        known = int(d.startswith(ISSUERS))
        shape = int(re.fullmatch(r"[0-9]{13,19}|([0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", found) is not None)
    else:
        known = int(d.startswith(CALLING)) if found.startswith("+") else -1
        shape = int(re.search(r"[ .()-]{3}", found) is None and found.rfind("(") <= found.rfind(")") and len(d) >= 9)
    cue = 1 if CUES[kind].search(text, max(0, start - CUE_REACH), start) else -1
    left, right = text[start - 1:start], text[end:end + 1]
    border = int(not left.isalnum() and not right.isalnum())
    code = 0
    for v in (int(strict), int(passes(kind, found)), known, cue, shape, border):
        code = code * 3 + v + 1
    bits = (len(found) >= 12) | (len(d) >= 9) << 1 | any(c in found for c in "-() ") << 2
    return code, int(bits)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in found)


DETECTED = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
            "spans array<struct<kind:int,start:long,end:long,base:boolean,votes:int,bits:int>>")
FOUND = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
         "found array<struct<kind:string,start:long,end:long,base:boolean>>")


def detect(docs: DataFrame) -> DataFrame:
    """One row per document: base counts and digest, and all candidate spans with their votes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()),
                                   ("votes", pa.int32()), ("bits", pa.int32())]))
        for b in chunks(batches, "text"):
            counts, sha, rows = np.zeros((b.num_rows, 4), np.int64), [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                base, more = spans(text or "")
                for k, *_ in base:
                    counts[i, k] += 1
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                rows.append([dict(zip(("kind", "start", "end", "base", "votes", "bits"), (k, s, e, strict, *votes(text, k, s, e, strict))))
                             for found, strict in ((base, True), (more, False)) for k, s, e in found])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(counts[:, k]) for k in range(4)], pa.array(sha, pa.string()), pa.array(rows, kind)],
                                             names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DETECTED)


def pattern_counts(detected: DataFrame) -> np.ndarray:
    """Rows (kind, votes, bits, count); the number of patterns is bounded by the encoding."""
    c = detected.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.bits").count()
    return np.array(sorted(tuple(r) for r in c.collect()), dtype=np.int64).reshape(-1, 4)


def vote_matrix(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3 ** (LABELERS - 1 - i) % 3 - 1 for i in range(LABELERS)], axis=-1)


def reliabilities(v: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """EM for two classes: (probability per pattern that it is personal, labeler rates
    (2, LABELERS): chance of voting 1 in class 0 and 1). Starts from the majority vote."""
    said = v >= 0
    p = np.clip(np.where(said, v, 0).sum(1) / np.maximum(said.sum(1), 1), 0.05, 0.95)
    rates = np.zeros((2, LABELERS))
    for _ in range(rounds):
        prior = np.clip((p @ n + 1) / (n.sum() + 2), 1e-6, 1 - 1e-6)
        for c, w in ((0, (1 - p) * n), (1, p * n)):
            ones, all_ = (w[:, None] * (v == 1)).sum(0), (w[:, None] * said).sum(0)
            better = 2.0 if c else 1.0        # pseudo-votes: a labeler is more right than wrong
            rates[c] = (ones + better) / (all_ + 3.0)
        log = [np.where(said, np.where(v == 1, np.log(rates[c]), np.log(1 - rates[c])), 0).sum(1) for c in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(log[0] + np.log(1 - prior) - log[1] - np.log(prior), -500, 500)))
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    return p, rates


def classifier_inputs(v: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(v), 1)), v == 1, v == 0, (bits[:, None] >> np.arange(3)) & 1], axis=1).astype(float)


def train(patterns: np.ndarray) -> dict[int, np.ndarray]:
    """Weights of the logistic span classifier per kind (Newton steps, ridge 1)."""
    model = {}
    for kind in np.unique(patterns[:, 0]) if len(patterns) else ():
        rows = patterns[patterns[:, 0] == kind]
        v, n = vote_matrix(rows[:, 1]), rows[:, 3].astype(float)
        p, _ = reliabilities(v, n)
        x = classifier_inputs(v, rows[:, 2])
        w = np.zeros(x.shape[1])
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + np.eye(len(w)), x.T @ (n * (p - q)) - w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        model[int(kind)] = w
    return model


def accepted(patterns: np.ndarray, model: dict[int, np.ndarray], threshold: float = THRESHOLD) -> dict[tuple[int, int, int], float]:
    """The (kind, votes, bits) patterns that the classifier takes for personal data, with their probability."""
    good = {}
    for kind, code, bits, _ in patterns:
        x = classifier_inputs(vote_matrix(np.array([code])), np.array([bits]))
        p = float(1 / (1 + np.exp(-np.clip(x @ model[int(kind)], -30, 30)))[0])
        if p >= threshold:
            good[int(kind), int(code), int(bits)] = p
    return good


def resolved(candidates: list[dict], chance: dict[tuple[int, int, int], float]) -> list[dict]:
    """The spans of a document that stay: base ones, and accepted ones that no more probable
    (then earlier, then longer) accepted one overlaps; by kind and start."""
    rated = sorted((-chance[key], s["start"], -s["end"], s["kind"]) for s in candidates
                   if not s["base"] and (key := (s["kind"], s["votes"], s["bits"])) in chance)
    out, starts, ends = [(s["kind"], s["start"], s["end"], True) for s in candidates if s["base"]], [], []
    for _, start, end, kind in rated:
        end = -end
        at = bisect(starts, start)
        if (at == 0 or ends[at - 1] <= start) and (at == len(starts) or end <= starts[at]):
            starts.insert(at, start)
            ends.insert(at, end)
            out.append((kind, start, end, False))
    return [dict(zip(("kind", "start", "end", "base"), (KINDS[k], *rest))) for k, *rest in sorted(out)]


def personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, counts and digest of the base spans, ``found``: all
    spans (kind name, start, end, base), by kind and start."""
    d = stored(detect(docs), "pii-candidates")
    patterns = pattern_counts(d)
    chance = accepted(patterns, train(patterns), threshold)
    plain = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for b in batches:
            found = [resolved(c, chance) for c in b.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in plain], pa.array(found, kind)], names=[*plain, "found"])
    return d.mapInArrow(run, FOUND)


def masked(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and text with every span replaced by its kind in angle brackets (doc_id must be unique)."""
    found = personal_data(docs, threshold).select("doc_id", "found")
    whole = F.coalesce(F.col("text"), F.lit(""))
    pieces = F.aggregate(F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))),
                         F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
                         lambda a, s: F.struct(F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(
                             a["out"], F.substring(whole, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">"))).alias("out"),
                             F.greatest(a["at"], s["end"]).alias("at")),
                         lambda a: F.concat(a["out"], F.substring(whole, (a["at"] + 1).cast("int"), F.length(whole))))
    return docs.select("doc_id", "text").join(found, "doc_id").select("doc_id", pieces.alias("text"))
