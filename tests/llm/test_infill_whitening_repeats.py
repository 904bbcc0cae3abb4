import hashlib
import math
import re

import numpy as np
import pytest
from strandgraph.llm import infill as I
from strandgraph.llm import repeats as R
from strandgraph.llm import whitening as W
from strandgraph.llm.queries import QUERIES, SQL

from ..oracle import connection, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
#: Columns whose names clash with those of the results.
CLASHING = "doc_id long, text string, n long, form string, kept string, data string, tie string, spans string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 5, "x", "y", "z", "u", "v") for i, t in rows], CLASHING)


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_previous_factors"])
def test_equal_to_sql(spark, con, name):
    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(con, SQL[name])


# --- fill in middle

TEXTS = [
    (1, None), (2, ""), (3, "abc"), (4, "abc def\n1é"), (5, "a <P> b"), (6, "x<S>y"), (7, "<M>"), (8, "😀 and <P <S <M> of<"), (9, "a<P"),
    (None, "no id at all"), (10, "word " * 60_000), (11, "\x00 nul"), (11, "\x00 nul"), (11, "same id"), *[(100 + i, f"text number {i}: <S and <P < M> here {i * i}") for i in range(150)],
]


def plain_loop(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_against_a_plain_loop(spark):
    got = [tuple(r) for r in I.fill_in_middle(docs(spark, TEXTS)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted(got, key=key) == sorted((plain_loop(*r) for r in TEXTS), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_outputs_give_texts_back(spark):
    rows = I.fill_in_middle(docs(spark, TEXTS)).withColumn("back", I.restored("output", "form")).collect()
    assert sorted(r["back"] for r in rows) == sorted(t or "" for _, t in TEXTS)


@pytest.mark.parametrize("prefix", ["", "<", "<P", "<S", "ends in <S", "ends in <"])
@pytest.mark.parametrize("suffix", ["", "P>", "M>", ">", "<M", "S> and"])
def test_pieces_of_markers_at_the_cuts(prefix, suffix):
    middle = "<M<S<P"
    assert I.restore(f"<P>{prefix}<S>{suffix}<M>{middle}", "psm") == prefix + middle + suffix
    assert I.restore(f"<S>{suffix}<P>{prefix}<M>{middle}", "spm") == prefix + middle + suffix


def test_fill_in_middle_of_nothing(spark):
    assert I.fill_in_middle(docs(spark, [])).collect() == []


# --- whitening

VECTORS = "vec_id long, embedding array<float>, component string, n string, whitened string, deviation string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], *"abcd") for i, v in rows], VECTORS)


def whole(v):
    return [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]


def test_jacobi_against_numpy():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 30):
        m = rng.normal(size=(n, n))
        m = m @ m.T
        values, axes = W.jacobi(m)
        assert np.allclose(values, np.sort(np.linalg.eigvalsh(m))[::-1])
        assert np.allclose(axes @ np.diag(values) @ axes.T, m) and np.allclose(axes.T @ axes, np.eye(n), atol=1e-14)
    graded = np.diag([1.0, 1e-8, 1e-16]) @ np.array([[4, 1, 1], [1, 4, 1], [1, 1, 4.0]]) @ np.diag([1.0, 1e-8, 1e-16])
    assert W.jacobi(graded)[0][2] == pytest.approx(3.6e-32, rel=1e-12)  # 54 / 15 of the scale: the determinants' ratio, far under the unit roundoff of the largest


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(300, 12)) @ np.diag(np.linspace(3, 0.01, 12)))]
    bad = [(1000, None), (1001, []), (1002, [None] + [1.0] * 11), (1003, [float("nan")] * 12), (1004, [float("inf")] + [0.0] * 11), (1005, [1.0, 2.0])]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (500, [0.0] * 12)]
    frame = vectors(spark, rows + bad)
    fitted = W.fit(frame)
    x = np.array([whole(v) for _, v in rows], object)
    sums = [int(s) for s in x.sum(0)]
    assert (fitted.n, list(fitted.sums)) == (len(rows), sums)
    off = x * len(rows) - np.array(sums, object)
    v = np.cov(x.astype(float).T, bias=True)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    assert np.allclose(fitted.values, values, rtol=1e-10)
    assert fitted.trace == pytest.approx(np.trace(v))
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]))
    got = sorted((tuple(r) for r in W.whitened(frame, fitted).collect()), key=key)
    far = [int((o * o).sum()) for o in off]
    z = (off.astype(float) / len(rows)) @ (axes[:, :8] * np.sign((axes * fitted.vectors).sum(0))[:8] / np.sqrt(values[:8]))
    want = sorted(((i, d, row.tolist()) for (i, _), d, row in zip(rows, far, z, strict=True)), key=key)
    assert [(g[0], int(g[1])) for g in got] == [(w[0], w[1]) for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-8)
    assert W.identity_error(frame, fitted) < 1e-9


@pytest.mark.parametrize(("rows", "size"), [([], 0), ([(1, None)], 0), ([(1, [1.0, 2.0])], 1), ([(1, [1.0, 2.0])] * 5, 5), ([(1, [3e38, 0.0]), (2, [0.0, 1.0])], 2)])
def test_whitening_without_variance_rows_or_bounds(spark, rows, size):
    frame = vectors(spark, rows)
    fitted = W.fit(frame)
    got = W.whitened(frame, fitted).collect()
    assert len(got) == size
    if size and len({str(v) for _, v in rows}) == 1:
        assert all(r["deviation"] == 0 and r["whitened"] == [None, None] for r in got) and W.identity_error(frame, fitted) is None


def test_deviation_beyond_64_bits():
    x = np.array([[1 << 40, 0], [0, 0]])
    fitted = W.Whitening(1 << 40, (5, 7), np.ones(2), np.eye(2), 2.0)
    assert fitted.deviation(x)[0] == ((1 << 80) - 5) ** 2 + 49


def test_whitening_of_the_table(spark):
    rows = QUERIES["op12_jacobi_whitening"](spark, SF).collect()
    assert len(rows) == 500 * 8 and {r["component"] for r in rows} == set(range(1, 9)) and {r["n"] for r in rows} == {500}
    z = np.zeros((500, 8))
    for r in rows:
        z[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(np.cov(z.T, bias=True) - np.eye(8)).max() < 1e-9 and rows[0]["identity_error"] < 1e-9
    share = [next(r["explained"] for r in rows if r["component"] == c) for c in range(1, 9)]
    assert share == sorted(share, reverse=True) and 0 < share[7] and sum(share) < 1


# --- repeated passages


def brute(rows):
    first, texts, out = {}, [(R.NO_ID if i is None else i, (t or "").encode()) for i, t in rows], []
    for i, b in texts:
        for s in range(len(b) - 99):
            first[b[s : s + 100]] = min(first.get(b[s : s + 100], (i, s)), (i, s))
    for i, b in texts:
        gone = np.zeros(len(b) + 2, bool)
        for s in range(len(b) - 99):
            if first[b[s : s + 100]] < (i, s):
                gone[s + 1 : s + 101] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
        out.append((None if i == R.NO_ID else i, bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]]), list(zip(edges[::2], edges[1::2], strict=True))))
    return sorted(out, key=lambda r: (r[0] is None, r))


def found(spark, rows):
    got = R.deduplicated(docs(spark, rows).repartition(3)).collect()
    assert all(r["n_removed"] == r["n_bytes"] - len(r["kept"]) == sum(s["end"] - s["start"] for s in r["spans"]) for r in got)
    return sorted(((r["doc_id"], bytes(r["kept"]), [(s["start"], s["end"]) for s in r["spans"]]) for r in got), key=lambda r: (r[0] is None, r))


def sentences(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghé"), int(rng.integers(2, 9)))) for _ in range(n))


def awkward():
    passage, line = sentences(80, 1), sentences(8, 2)
    rows = [(0, None), (1, ""), (2, "short"), (3, "a" * 99), (4, "a" * 100), (5, "a" * 350), (6, "ab" * 120), (7, "ba" * 130), (8, passage), (9, passage)]
    rows += [(20 + i, f"{sentences(20, 100 + i)} {line} {sentences(25, 200 + i)} {passage[i : 330 - 3 * i]}{sentences(9, 300 + i)}") for i in range(40)]
    rows += [(200 - i, f"{passage} {line * 3} {i}") for i in range(30)]  # the smallest id comes last
    rows += [(300, passage), (300, passage), (300, f"x{passage}"), (None, passage), (None, f"{passage} {line}"), (None, sentences(50, 9)), (400, sentences(50, 9))]
    rows += [(-5, passage[50:260]), (500, sentences(40, 11) + passage[:99]), (501, passage[:100]), (502, "é" * 50 + "b"), (503, "xé" * 60 + "é" * 50)]
    return rows


def test_repeats_against_brute_force(spark):
    rows = awkward()
    assert found(spark, rows) == brute(rows)


def test_repeats_in_small_windows_chunks_and_with_frequent_grams(spark, monkeypatch):
    rows = awkward()
    # Python workers start from the parent's state for each task's closure, so the settings go through the functions' own module.
    for frequent, bits in ((np.empty(0, np.uint64), 10), (np.unique(R.hashed(np.frombuffer(rows[8][1].encode(), np.uint8).astype(np.uint64))), 12)):
        monkeypatch.setattr(R, "frequent_grams", lambda docs, n, f=frequent: f)
        monkeypatch.setattr(R, "BUCKET_BITS", (bits, bits))
        assert found(spark, rows) == brute(rows)


def test_long_texts_cross_windows():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 123, 5000).astype(np.uint8)
    offsets = np.array([0, 1200, 1250, 5000])

    def starts(window):
        old, R.WINDOW = R.WINDOW, window
        try:
            return {(int(a), int(s) + i) for an, st, n in R.runs(text, offsets, None) for a, s, k in zip(an, st, n, strict=True) for i in range(k)}
        finally:
            R.WINDOW = old

    every = starts(1 << 21)
    assert {s for _, s in every} == {*range(1101), *range(1250, 4901)}
    assert starts(300) == every and starts(101) == every


def test_a_text_of_one_repeated_letter_and_a_very_long_text(spark):
    rows = [(1, "z" * 200_000), (2, "z" * 500), (3, sentences(30_000, 5)), (4, sentences(30_000, 5)[1000:90_000])]
    got = {r["doc_id"]: (r["n_removed"], len(r["spans"])) for r in R.deduplicated(docs(spark, rows)).collect()}
    assert got[1] == (199_999, 1) and got[2] == (500, 1) and got[3] == (0, 0) and got[4][1] == 1 and got[4][0] == len(rows[3][1].encode())


def test_repeats_of_nothing(spark):
    assert R.deduplicated(docs(spark, [])).collect() == []


def test_longest_previous_factors_of_a_short_string():
    text = np.frombuffer(b"abaababaabab", np.uint8)
    n = len(text)
    order = sorted(range(n), key=lambda i: text[i:].tobytes())
    share = lambda a, b: next((k for k in range(n - max(a, b)) if text[a + k] != text[b + k]), n - max(a, b))
    common = np.array([0] + [share(order[i - 1], order[i]) for i in range(1, n)])
    for least in range(1, 7):
        want = [any(share(i, j) >= least for j in range(i)) for i in order]
        assert R.earlier(common, np.array(order), least).tolist() == want
