"""Personal data by weak supervision.

Candidates are the base spans (email, ip, card, phone) and looser ones: other numbers
of 9 to 19 digits, spelled-out addresses ("name (at) host") and titled names. Labelers
of three sorts vote yes, no or nothing on each: shapes (regular expressions and lengths),
gazetteers (`Gazetteers`, a parameter: domain endings, country codes, issuers, given names)
and context (words before the span, characters beside it). The votes of the whole corpus are
counted by pattern; expectation-maximisation over these counts estimates each labeler's
reliability. A logistic span classifier is then trained on the resulting posteriors, over the
votes and over marks of the span and its surroundings that no labeler reads. Looser
candidates that it accepts become spans; base spans stay.

The driver holds one row for each pattern of votes and marks: a number fixed by the labelers,
not the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, map_texts, table

# The base kinds and their patterns.
BASE = ("email", "ip", "card", "phone")
LOOSE = ("number", "address", "name")
KINDS = (*BASE, *LOOSE)
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Runs of any length, each tried from its begin only and never given back, so the time is linear in the text.
ADDRESS = re.compile(r"(?<![\w.+-])[\w.+-]++ ?[(\[](?:at|AT)[)\]] ?[\w-]++(?: ?[(\[](?:dot|DOT)[)\]] ?[\w-]++)++")
NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? [^\W\d_]\w++(?: [A-ZÀ-Þ]\w++)?")


class Gazetteers(NamedTuple):
    """Lists that labelers look spans up in; others may be given in their place."""

    endings: frozenset[str]
    calling_codes: tuple[str, ...]
    issuers: tuple[str, ...]
    given_names: frozenset[str]


# Common domain endings, country calling codes, first digits of card issuers, given names; and context words.
GAZETTEERS = Gazetteers(
    frozenset(
        "com org net edu gov mil int info biz name pro io ai app dev me tv co eu de fr es uk us ca au nz ie at ch be nl lu it pt pl cz sk hu ro bg gr se no dk fi is ee lv lt "
        "ru ua by tr il in cn jp kr tw hk sg my th vn id ph br ar cl mx pe ve za eg ma ng ke example test".split()
    ),
    tuple(
        "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 220 221 225 233 234 "
        "237 243 244 251 254 255 256 260 263 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 380 381 382 385 386 387 389 420 421 423 "
        "852 853 855 880 886 960 961 962 963 964 965 966 967 968 971 972 973 974 975 976 977 992 993 994 995 996 998".split()
    ),
    ("34", "36", "37", "4", "51", "52", "53", "54", "55", "6011", "62", "65"),
    frozenset(
        "james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen anna emma olivia noah lucas "
        "hans peter klaus wolfgang jürgen stefan andreas ursula monika petra sabine heike jean pierre michel andré philippe alain marie nathalie isabelle sylvie françoise "
        "josé antonio manuel francisco juan carlos luis carmen maría pilar dolores isabel lucía pablo javier".split()
    ),
)
ABOUT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
    "number": ("card", "account", "iban", "phone", "tel", "ssn", "passport", "konto", "cuenta", "compte"),
    "address": ("mail", "contact", "write"),
    "name": ("patient", "name", "dear", "signed"),
}
OTHERWISE = ("version", "isbn", "order", "build", "commit", "hash", "rev", "page", "copyright")
#: Characters before a span that context labelers read.
CONTEXT = 40
LABELERS, MARKS = 5, 6
CODES = len(KINDS) * 3**LABELERS


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, odd)) + sum(x - 9 if x > 9 else x for x in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of an address; each @ is tried once, so the time is linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans by start, then kind as listed; and the loose numbers that the same scan finds."""
    out, loose = [], []
    if "@" in text:
        out += [(s, e, 0) for s, e in emails(text)]
    if re.search("[0-9]", text):
        out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in DIGITS.finditer(text):
            n = m.end() - m.start()
            if n < 9:
                continue
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
            elif 9 <= len(digits) <= 19:
                loose.append((m.start(), m.end(), "number"))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    out.sort(key=lambda x: (x[0], x[2], x[1]))
    return [(s, e, BASE[k]) for s, e, k in out], loose


def found_in(text: str) -> list[tuple[int, int, str]]:
    """Base spans, then loose candidates that overlap none of them."""
    base, loose = base_spans(text)
    if "at)" in text or "at]" in text or "AT)" in text or "AT]" in text:
        loose += [(m.start(), m.end(), "address") for m in ADDRESS.finditer(text)]
    loose += [(m.start(), m.end(), "name") for m in NAME.finditer(text)]
    taken = np.array([(s, e) for s, e, _ in base] or [(-1, -1)])
    return base + sorted(x for x in loose if not ((taken[:, 0] < x[1]) & (x[0] < taken[:, 1])).any())


def votes(text: str, start: int, end: int, kind: str, lists: Gazetteers = GAZETTEERS) -> tuple[int, ...]:
    """The labelers' votes: 2 yes, 0 no, 1 nothing."""
    span = text[start:end]
    digits = "".join(c for c in span if c.isdigit())
    last = re.split(r"\W", span.rstrip(")] "))[-1].lower()
    known = 1
    if kind in ("email", "address"):
        shape = 2 if last.isalpha() and 2 <= len(last) <= 10 and len(span.partition("@")[0]) <= 64 else 0
        known = 2 if last in lists.endings else 0
    elif kind == "ip":
        shape = 0 if re.search(r"(?<![0-9])0[0-9]", span) else 2
        known = 0 if span.startswith(("0.", "127.", "255.")) else 2
    elif kind == "card":
        shape = 2 if len(digits) in (15, 16) else 1
        known = 2 if digits.startswith(lists.issuers) else 0
    elif kind == "phone":
        shape = 2 if 10 <= len(digits) <= 13 else 1
        known = 2 if digits.startswith(lists.calling_codes) else 0
    elif kind == "number":
        shape = 2 if len(digits) in (10, 11, 13, 14, 15, 16) else 0
        known = 2 if len(digits) >= 13 and digits.startswith(lists.issuers) else 1 if len(digits) >= 13 else 2 if digits.startswith(lists.calling_codes) and len(digits) >= 10 else 1
    else:
        words = span.split()[1:]
        shape = 2 if all(w[:1].isupper() for w in words) else 0
        known = 2 if any(w.lower() in lists.given_names for w in words) else 1
    before = text[max(0, start - CONTEXT) : start].lower()
    told = 2 if any(w in before for w in ABOUT[kind]) else 1
    denied = 0 if any(w in before for w in OTHERWISE) else 1
    glued = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    return shape, known, told, denied, 0 if glued else 2


def marks_of(text: str, start: int, end: int) -> int:
    """What the classifier reads of a span besides the votes, as bits: long, set in groups, all digits, after a sign, at a line's begin, before the end of a phrase."""
    span, after = text[start:end], text[end : end + 1]
    line = text[max(0, start - 3) : start].strip(" \t")
    bits = (end - start > 14, any(c in " -." for c in span), span.isdigit(), text[max(0, start - 2) : start].rstrip()[-1:] in tuple(":=#"), start == 0 or line[-1:] == "\n", not after or after in ".,;:!?\n)")
    return sum(int(b) << i for i, b in enumerate(bits))


def code_of(kind: str, cast: tuple[int, ...]) -> int:
    code = KINDS.index(kind)
    for v in cast:
        code = code * 3 + v
    return code


def pattern_of(text: str, start: int, end: int, kind: str, lists: Gazetteers = GAZETTEERS) -> int:
    """Kind, votes and marks of a span as one number: the code of kind and votes, plus CODES for each step of the marks."""
    return code_of(kind, votes(text, start, end, kind, lists)) + CODES * marks_of(text, start, end)


def decoded(code: int) -> tuple[str, tuple[int, ...]]:
    cast = []
    code %= CODES
    for _ in range(LABELERS):
        code, v = divmod(code, 3)
        cast.append(v)
    return KINDS[code], tuple(reversed(cast))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lists: Gazetteers = GAZETTEERS) -> DataFrame:
    """One row per row of docs: id, found (array of start, end, kind, pattern)."""

    def start():
        def work(texts):
            return None, ([
                [{"start": s, "end": e, "kind": k, "code": pattern_of(t, s, e, k, lists)} for s, e, k in found_in(t)] if t else []
                for t in texts
            ],)

        return work

    return map_texts(docs, text_col, {id_col: id_col}, start, "found array<struct<start: int, end: int, kind: string, code: int>>")


def reliabilities(counts: dict[int, int], rounds: int = 50) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of each pattern, and P(vote | class) of each labeler as [labeler, class, vote].

    Two classes with a prior for each kind; begins at the share of yes votes.
    """
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], float)
    kinds = np.array([KINDS.index(decoded(c)[0]) for c in codes])
    cast = np.array([decoded(c)[1] for c in codes]).reshape(len(codes), LABELERS)
    p = np.clip((cast - 1).sum(1) / LABELERS * 0.5 + 0.5, 0.05, 0.95)
    rates = np.zeros((LABELERS, 2, 3))
    for _ in range(rounds):
        for k, share in ((1, p), (0, 1 - p)):
            for v in range(3):
                rates[:, k, v] = ((cast == v) * (n * share)[:, None]).sum(0) + 1
        rates /= rates.sum(2, keepdims=True)
        prior = np.array([((n * p)[kinds == k].sum() + 1) / (n[kinds == k].sum() + 2) for k in range(len(KINDS))])
        odds = np.log(prior / (1 - prior))[kinds]
        for j in range(LABELERS):
            odds = odds + np.log(rates[j, 1, cast[:, j]] / rates[j, 0, cast[:, j]])
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(codes, p.tolist(), strict=True)), rates


def span_features(pattern: int) -> list[float]:
    kind, cast = decoded(pattern)
    marks = pattern // CODES
    return [1.0, *[float(kind == k) for k in LOOSE], *[float(v == x) for v in cast for x in (0, 2)], *[float(marks >> i & 1) for i in range(MARKS)]]


def train(posterior: dict[int, float], counts: dict[int, int], ridge: float = 1.0) -> dict[int, float]:
    """The span classifier's probability for each pattern in counts: ridge logistic regression on the posteriors of their codes, weighted by counts."""
    patterns = sorted(counts)
    if not patterns:
        return {}
    x = np.array([span_features(c) for c in patterns])
    y = np.array([posterior[c % CODES] for c in patterns])
    n = np.array([counts[c] for c in patterns], float)
    n = n / n.max() * 1000 + 1
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + ridge * w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return dict(zip(patterns, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))


def accepted(found: DataFrame, threshold: float = 0.5) -> list[int]:
    """Patterns of loose candidates that the classifier, trained on all votes in found, takes for personal data."""
    rows = found.select(F.explode("found").alias("f")).groupBy("f.code").agg(F.count("*").alias("n"))
    counts = {r["code"]: r["n"] for r in rows.toLocalIterator()}  # at most CODES * 2 ** MARKS rows
    by_code: dict[int, int] = {}
    for c, n in counts.items():
        by_code[c % CODES] = by_code.get(c % CODES, 0) + n
    posterior, _ = reliabilities(by_code) if by_code else ({}, None)
    return sorted(c for c, p in train(posterior, counts).items() if p >= threshold and decoded(c)[0] in LOOSE)


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lists: Gazetteers = GAZETTEERS) -> DataFrame:
    """One row per row of docs: id, base and extra (arrays of start, end, kind; base by start, then kind).

    Null and empty texts have no spans. Repeated rows are scanned one by one, an empty table gives an empty
    result, and other columns are not looked at. Positions are code points, end exclusive.
    """
    found = checkpoint(scanned(docs, id_col, text_col, lists))
    codes = accepted(found)
    return found.select(
        id_col,
        F.filter("found", lambda x: x["kind"].isin(*BASE)).alias("base"),
        F.filter("found", lambda x: x["code"].isin(codes) if codes else F.lit(False)).alias("extra"),
    )


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, lists: Gazetteers = GAZETTEERS) -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; overlapping spans become one, of the first's kind.

    length_col, if given, is set to the new text's length in code points. Null texts stay null, empty ones empty;
    ids may be null or repeat, texts may be of any length, and an empty table gives an empty result. Texts are read
    twice, as the classifier needs the votes of all of them first and no text is written or sent in between.
    """
    codes = frozenset(accepted(checkpoint(scanned(docs, id_col, text_col, lists))))

    def start():
        def clean(text: str | None) -> str | None:
            if not text:
                return text
            out, at = [], 0
            spans = [(s, e, k) for s, e, k in found_in(text) if k in BASE or pattern_of(text, s, e, k, lists) in codes]
            merged: list[list] = []
            for s, e, k in sorted(spans):
                if merged and s < merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e, k])
            for s, e, k in merged:
                out += text[at:s], f"<{k.upper()}>"
                at = e
            return "".join([*out, text[at:]])

        return lambda texts: (None, ([clean(t) for t in texts],))

    names = docs.columns
    marked = {f"c{i}": n for i, n in enumerate(names)}
    out = map_texts(docs, text_col, marked, start, "clean string")
    back = [F.col("clean").alias(n) if n == text_col else F.length("clean").cast(docs.schema[n].dataType).alias(n) if n == length_col else F.col(f"c{i}").alias(n) for i, n in enumerate(names)]
    return out.select(*back)


def written(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op10_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = personal_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    kinds = F.array(*map(F.lit, KINDS))
    order = lambda x: F.struct(x["start"].alias("start"), F.array_position(kinds, x["kind"]).alias("place"), x["end"].alias("end"), x["kind"].alias("kind"))
    every = F.array_sort(F.transform(F.concat("base", "extra"), order))
    return spans.select("doc_id", *map(count, BASE), F.sha2(written("base"), 256).alias("base_sha256"), written(every).alias("spans"))


QUERIES = {"op10_weak_supervision_pii": op10_weak_supervision_pii}
SQL: dict[str, str] = {}
