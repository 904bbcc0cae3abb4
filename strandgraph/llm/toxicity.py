"""Toxicity scoring of restored text.

Writers hide words as "1d10t", "i d i o t", "idiooot" or all of it at once. Each
suspicious stretch of a text, however long, becomes a lattice: a digit or sign may stand
for a letter, separators between single letters or signs may be noise, a run of a letter
may stand for one or two. Viterbi
decoding picks the likeliest path under a noisy channel and a character trigram model,
whose counts come from every word of the whole corpus. Stretches that offer one path
only are left as they are. The restored text is then scored by a logistic model over
character n-grams that tell the labels apart.

The classifier is fitted on a bounded sample of labelled rows (`TRAIN_ROWS`, smallest
hash of the id first; texts that are copies but for a few words count once); the language model and the scores cover all documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Lookup, checkpoint, folded, keep_texts, map_texts, rolling, rolling_up, table, windows

TRAIN_ROWS = 12_000
THRESHOLD = 0.3
#: Lengths of n-grams, how many the classifier uses, and for how many at a time the two classes are counted.
GRAMS, FEATURES, SLICE = (4, 5, 6), 512, 100_000
#: Words kept in a task's counter before it is passed on.
COUNTER_WORDS = 200_000

# What the channel may have turned into what, and at which cost in nats (fixed values).
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
COST_LEET, COST_JOIN, COST_RUN, COST_SIGN = 1.0, 0.5, 0.5, 9.0

_SIGNS = re.escape("".join(c for c in LEET if not c.isdigit()))
_DIGITS = "".join(c for c in LEET if c.isdigit())
_PLACE, _APART = rf"[^\W\d_]|[{_DIGITS}{_SIGNS}]", rf"[^\w{_SIGNS}]|_"
#: Letters or LEET signs, alone or repeated, three or more of them set apart by runs of separators.
SPACED = re.compile(rf"(?i:(?<![^\W_])(?:({_PLACE})(?<!\1\1)\1*+(?:{_APART})++){{2,}}({_PLACE})\2*+(?![^\W_]))")
#: The same, or a word with a digit or sign at its letters, or a letter three times or more.
SUSPECT = re.compile(rf"{SPACED.pattern}|(?<![\w{_SIGNS}])[\w{_SIGNS}]*?(?:[^\W\d_][\d@$]|[\d{_SIGNS}][^\W\d_]|([^\W\d_])\3\3)[\w{_SIGNS}]*")
#: Longer stretches are read anew each time, so that the cache stays small.
CACHED_STRETCH = 200

LETTER, SIGN, GAP, ALNUM = 1, 2, 4, 8
_CLASS: list[np.ndarray] = []


def classes(codes: np.ndarray) -> np.ndarray:
    """What each character may be in a hidden word, as bits."""
    if not _CLASS:
        bits = np.zeros(65536, np.uint8)
        for i in range(65536):
            c = chr(i)
            bits[i] = LETTER * c.isalpha() | SIGN * (c in LEET) | GAP * c.isspace() | ALNUM * c.isalnum()
        _CLASS.append(bits)
    return _CLASS[0][np.minimum(codes, 65535)]


class CharModel:
    """log P(letter | two letters before), letters a-z and 0 for a word's edge, interpolated with lower orders."""

    def __init__(self, words: Iterator[tuple[str, int]]):
        n = np.full((27, 27, 27), 0.01)
        for gram, count in words:
            a, b, c = (ord(x) - 96 if x != " " else 0 for x in gram)
            n[a, b, c] += count
        two, one = n.sum(0), n.sum((0, 1))
        p1 = one / one.sum()
        p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
        p3 = (n + 5 * p2) / (n.sum(2, keepdims=True) + 5)
        self.log = np.log(p3).tolist()


_PLAIN: dict[str, str] = {}


def plain(c: str) -> str:
    """The letter a-z that a letter is at heart, else a space."""
    got = _PLAIN.get(c)
    if got is None:
        base = unicodedata.normalize("NFKD", c)[:1].lower()
        got = _PLAIN[c] = base if "a" <= base <= "z" else " "
    return got


def decode(stretch: str, model: CharModel) -> str:
    """The likeliest reading of a stretch, in time linear in its length."""
    spaced = SPACED.fullmatch(stretch) is not None
    if spaced and not any(c.isalpha() for c in stretch):
        return stretch
    steps: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(stretch):
        c = stretch[i]
        j = i
        if spaced and not c.isalnum() and c not in LEET:
            while not stretch[j].isalnum() and stretch[j] not in LEET:
                j += 1
            steps.append([("", COST_JOIN), (" ", 0.0)])
            i = j
            continue
        low = c.lower()
        while j < len(stretch) and stretch[j].lower() == low:
            j += 1
        run = j - i
        if c.isalpha():
            if run >= 3:
                steps.append([(c, COST_RUN), (c * 2, COST_RUN), (c * run, 0.0)])
            elif spaced and run == 2:
                steps.append([(c, COST_RUN), (c * 2, 0.0)])
            else:
                steps.append([(c * run, 0.0)])
        elif c in LEET:
            edge = [(c * run, COST_SIGN)]
            steps.append(edge + [(x * n, COST_LEET * n) for x in LEET[c] for n in sorted({1, min(run, 2)}) if run < 3 or n == 1])
        else:
            steps.append([(c * run, 0.0)])
        i = j
    # What was read so far is a chain of (what came before, text).
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in [*steps, [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, chain) in best.items():
            for out, extra in options:
                x, y, total = a, b, cost + extra
                for c in out[:3]:
                    p = plain(c)
                    z = ord(p) - 96 if p != " " else 0
                    total -= model.log[x][y][z] if y or z or x else 0.0
                    x, y = y, z
                if len(out) > 3 and y:  # a run of one character
                    total -= (len(out) - 3) * model.log[y][y][y]
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, (chain, out))
        best = after
    chain = min(best.values(), key=lambda v: v[0])[1]
    parts = []
    while chain:
        chain, out = chain
        parts.append(out)
    return "".join(parts[:0:-1])


def apart(codes: np.ndarray, kind: np.ndarray, low: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of stretches with three or more neighbouring words of one repeated letter or sign each."""
    alnum = kind & ALNUM > 0
    wordy = kind & (ALNUM | SIGN) > 0
    new = wordy.copy()
    new[1:] &= ~(wordy[:-1] & (alnum[1:] == alnum[:-1]))
    starts = np.flatnonzero(new)
    if len(starts) < 3:
        return []
    other = wordy & ~new
    other[1:] &= low[1:] != low[:-1]
    one = ~np.logical_or.reduceat(other, starts) & (kind[starts] & (LETTER | SIGN) > 0)
    three = np.flatnonzero(one[:-2] & one[1:-1] & one[2:])
    if not len(three):
        return []
    first = np.flatnonzero(np.diff(three, prepend=-9) > 1)
    last = np.append(first[1:], len(three)) - 1
    return list(zip(starts[three[first]].tolist(), starts[three[last] + 2].tolist(), strict=True))


def suspicious(codes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of words that may hide something, as (start, end)."""
    if len(codes) < 3:
        return []
    kind = classes(codes)
    letter, sign = kind & LETTER > 0, kind & SIGN > 0
    mark = np.zeros(len(codes), bool)
    mark[1:] |= letter[1:] & sign[:-1]
    mark[:-1] |= letter[:-1] & sign[1:] & ((codes[1:] == 64) | (codes[1:] == 36) | (codes[1:] < 58) & (codes[1:] > 47))
    low = codes | 32
    mark[2:] |= letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
    places, spaced = np.flatnonzero(mark), apart(codes, kind, low)
    if not len(places) and not spaced:
        return []
    gaps = np.concatenate([[-1], np.flatnonzero(kind & GAP), [len(codes)]])
    found = [np.searchsorted(gaps, places)]
    found += [np.arange(a, b + 1) for a, b in np.searchsorted(gaps, np.array(spaced, np.int64).reshape(-1, 2)).tolist()]
    words = np.unique(np.concatenate(found))
    first = np.flatnonzero(np.diff(words, prepend=-9) > 1)
    last = np.append(first[1:], len(words)) - 1
    return list(zip((gaps[words[first] - 1] + 1).tolist(), gaps[words[last]].tolist(), strict=True))


def restored(text: str, model: CharModel, cache: dict[str, str]) -> str:
    """The text with each suspicious stretch in its likeliest reading."""
    out, at = [], 0
    for start, end in suspicious(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)):
        stretch = text[start:end]
        got = cache.get(stretch)
        if got is None:
            got = SUSPECT.sub(lambda m: decode(m[0], model), stretch)
            if len(stretch) <= CACHED_STRETCH:
                if len(cache) > 100_000:
                    cache.clear()
                cache[stretch] = got
        out += text[at:start], got
        at = end
    return "".join([*out, text[at:]]) if out else text


_NOT_LETTERS = re.compile(r"[\W\d_]+")


def _trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    grams: Counter = Counter()

    def count(words: Counter) -> None:
        for word, n in words.items():
            for part in _NOT_LETTERS.split(word):
                if part:
                    low = "  " + (part.lower() if part.isascii() else "".join(map(plain, part))) + " "
                    for i in range(len(low) - 2):
                        grams[low[i : i + 3]] += n

    words: Counter = Counter()
    for batch in batches:
        for text in batch["text"]:
            if text:
                words.update(text.split())
                if len(words) > COUNTER_WORDS:
                    count(words)
                    words.clear()
    count(words)
    kept = [(g, n) for g, n in grams.items() if g.replace(" ", "a").isascii() and g.replace(" ", "a").isalpha()]
    yield pd.DataFrame(kept, columns=["gram", "n"])


def char_model(docs: DataFrame, text_col: str = "text") -> CharModel:
    """Trigram counts over all texts. At most 27^3 rows reach the driver, whatever the corpus."""
    counts = docs.select(F.col(text_col).alias("text")).mapInPandas(_trigrams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return CharModel((r["gram"], r["n"]) for r in counts.toLocalIterator())


def grams_of(text: str) -> np.ndarray:
    """Distinct hashed n-grams of the letters and digits of a text, words set apart by one space."""
    codes = folded(" " + text.replace("\x00", " ") + " ")[0]
    return np.unique(np.concatenate(list(rolling_up(codes, GRAMS))))


class ToxicityModel:
    """A language model for restoring and weights of n-grams for scoring."""

    def __init__(self, chars: CharModel, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.chars, self.keys, self.weights, self.bias = chars, keys, weights, bias

    def scores(self, texts: list[str | None], cache: dict[str, str], lookup: Lookup) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        read = [" " + restored(t, self.chars, cache).replace("\x00", " ") + " " if t else "" for t in texts]
        seen = []
        for parts, window in windows(read, 16):
            codes = folded(window)[0]
            starts = np.append(0, np.flatnonzero(codes == 0))
            which = np.array([p[0] for p in parts])
            for h in rolling_up(codes, GRAMS):
                at, key = lookup.find(h)
                seen.append(which[np.searchsorted(starts, at, "right") - 1] * np.int64(1 << 20) + key)
        if seen:
            seen = np.unique(np.concatenate(seen))
            np.add.at(z, seen >> 20, self.weights[seen & ((1 << 20) - 1)])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _train_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """At most `rows` labelled texts, equal ones once; a repeated label counts as toxic if any is."""
    marked = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marked), "id")
    return texts.groupBy(F.md5("text").alias("m")).agg(F.max("y").alias("y"), F.min("text").alias("text")).drop("m")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fits the language model on docs and the classifier on at most `rows` rows of labels, which may be
    fewer or none: without both classes every score is the share of toxic labels, 0 if there are none.

    What reaches the driver is bounded by rows, FEATURES and the alphabet.
    """
    chars = char_model(docs, text_col)

    def start():
        cache: dict[str, str] = {}

        def work(texts):
            read = [restored(t or "", chars, cache) for t in texts]
            # Texts that share both the least and the greatest of their runs of 24 characters are copies, but for a few words: one of
            # them counts. Shorter texts stand for themselves.
            runs = (rolling(folded(t)[0], 24) for t in read)
            return None, ([f"{r.min()}:{r.max()}" if len(r) else t for r, t in zip(runs, read, strict=True)], read)

        return work

    spread = max(2, min(docs.sparkSession.sparkContext.defaultParallelism * 2, 64))
    train = _train_rows(docs, labels, id_col, text_col, label_col, rows).repartition(spread)
    train = map_texts(train, "text", {"y": "y"}, start, "family string, read string")
    train = checkpoint(train.groupBy("family", "y").agg(F.min("read").alias("read")).select("y", "read"))
    total = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    if not toxic or not clean:
        share = toxic / max(1, toxic + clean)
        return ToxicityModel(chars, np.empty(0, np.uint64), np.empty(0), -30.0 if share == 0 else 30.0)

    least = max(2, toxic // 200)
    common = checkpoint(train.where("y = 1").mapInPandas(_counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    # All n-grams are weighed, a slice of them at a time; of each slice the best stay.
    slices = -(-common.count() // SLICE)
    best = pd.DataFrame({"gram": np.empty(0, np.int64), "gain": np.empty(0)})
    for number in range(slices):
        own = common.where(F.pmod(F.xxhash64("gram"), F.lit(slices)) == number).toPandas()
        own["gain"] = _gains(train, own, toxic, clean)
        best = pd.concat([best, own.loc[own["gain"] > 3, ["gram", "gain"]]]).sort_values(["gain", "gram"], ascending=[False, True]).head(FEATURES)
    keys = np.sort(best["gram"].to_numpy(np.int64).view(np.uint64))
    lookup = Lookup(keys)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "f": [lookup.find(grams_of(t))[1].astype(np.int32) for t in batch["read"]]})

    sample = train.mapInPandas(features, "y int, f array<int>").toPandas()
    x = np.zeros((len(sample), len(keys) + 1), np.float32)
    x[:, -1] = 1
    for i, f in enumerate(sample["f"]):
        x[i, f] = 1
    weights = logistic(x, sample["y"].to_numpy(float))
    return ToxicityModel(chars, keys, weights[:-1], float(weights[-1]))


def _gains(train: DataFrame, common: pd.DataFrame, toxic: int, clean: int) -> np.ndarray:
    """How much likelier the toxic rows get if an n-gram (gram, n: toxic rows that hold it) may tell the classes apart."""
    grams = common["gram"].to_numpy(np.int64)
    keys = np.sort(grams.view(np.uint64))
    lookup = Lookup(keys)

    def clean_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(keys), np.int64)
        for batch in batches:
            for text in batch["read"]:
                n[lookup.find(grams_of(text))[1]] += 1
        at = np.flatnonzero(n)
        yield pd.DataFrame({"gram": keys[at].view(np.int64), "n": n[at]})

    counted = train.where("y = 0").mapInPandas(clean_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    b = counted.set_index("gram")["n"].reindex(grams, fill_value=0).to_numpy(float)
    a = common["n"].to_numpy(float)
    p, q = (a + 0.5) / (toxic + 1), (b + 0.5) / (clean + 1)
    return np.where(p > q, a * np.log(p / q) + (toxic - a) * np.log((1 - p + 1e-9) / (1 - q + 1e-9)), 0)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 500):
            found, n = np.unique(np.concatenate([grams_of(t) for t in batch["read"].iloc[at : at + 500]]), return_counts=True)
            yield pd.DataFrame({"gram": found.view(np.int64), "n": n})


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last column is the bias and isn't penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p) + 1e-6)[:, None].astype(x.dtype)).T @ x + np.diag(penalty)
        step = np.linalg.solve(h.astype(float), grad)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return w


def toxicity_scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, score, predicted for each row, in any order of rows. Null and empty texts get the score of a text without
    any telling n-gram; nulls in other columns and further columns make no difference; repeated rows give repeated results."""
    lookup = Lookup(model.keys, 16)

    def start():
        cache: dict[str, str] = {}

        def work(texts):
            s = model.scores(texts, cache, lookup)
            return None, (s, (s >= threshold).astype(np.int32))

        return work

    return map_texts(docs, text_col, {id_col: id_col}, start, "score double, predicted int")


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> ToxicityModel:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    return fit(docs, labels)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity_scores(docs, fitted(spark, docs, sf_dir))
    return scores.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that the model rejects; the text itself decides, so rows are scored in place."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    model = fit(docs, labels)
    lookup = Lookup(model.keys, 16)

    def start():
        cache: dict[str, str] = {}
        return lambda texts: model.scores(texts, cache, lookup) < THRESHOLD

    return keep_texts(docs, "text", start)


QUERIES = {"op2_toxicity": op2_toxicity}
SQL: dict[str, str] = {}
