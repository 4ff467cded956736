"""Near-duplicates by MinHash, spelling variants and whitening against brute force, and odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sitelake.llm import minhash, spelling, whitening
from sitelake.llm.queries import QUERIES

SMALL, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, None, "c"), (2, "", "c"), (None, "a b c d", "c"), (3, "A b\tC d", "c"), (3, "A b\tC d", "c"), (4, "x " * 100_000, "c"), (5, "é ß x\ny", "c"), (6, "a b", "c"), (7, "A  B", "c"), (None, "only here", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, component_id string")


# --- MinHash


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)]) if w else frozenset()


def jaccard_groups(rows, percent=85):
    """(doc_id, size of set, least id reachable) of rows (doc_id, text), by comparing all pairs of sets that share a shingle."""
    sets = [shingles(text) for _, text in rows]
    parent, holders = list(range(len(rows))), defaultdict(list)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in holders[g])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for g in s:
            holders[g].append(i)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return [(key, len(s), least.get(root(i)) if s else key) for i, ((key, _), s) in enumerate(zip(rows, sets))]


def collected(groups):
    return Counter(map(tuple, groups.select("doc_id", "n_shingles", "component_id", "kept").collect()))


def expected(rows, percent=85):
    return Counter((a, n, c, a == c) for a, n, c in jaccard_groups(rows, percent))


def test_minhash_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = expected(rows)
    assert collected(QUERIES["op11_minhash_dedup"](spark, SMALL)) == want
    assert sum(n for (*_, kept), n in want.items() if not kept) > 20


def families(seed=3):
    """Groups of copies, edited more and less, so that similarities lie on both sides of the threshold."""
    rng = random.Random(seed)
    rows = []
    for g in range(6):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([12, 60, 200]))]
        for _ in range(25):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                text[rng.randrange(len(text))] = f"v{rng.randrange(4000)}"
            rows.append((len(rows) * 7 % 151, " ".join(text)))
    return rows


@pytest.mark.parametrize("percent", [85, 70])
def test_minhash_links_are_exact_in_blocks_of_any_size(spark, monkeypatch, percent):
    rows = families()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(minhash.minhash_groups(docs, percent)) == expected(rows, percent)
    monkeypatch.setattr(minhash, "LIST_BLOCK", 4)
    monkeypatch.setattr(minhash, "SET_BLOCK", 700)
    monkeypatch.setattr(minhash, "FILTER_BITS", 1)
    assert collected(minhash.minhash_groups(docs, percent)) == expected(rows, percent)


def test_minhash_odd_rows(spark, odd):
    rows = [(r[0], r[1]) for r in ODD]
    assert collected(minhash.minhash_groups(odd)) == expected(rows)
    assert minhash.minhash_groups(odd.limit(0)).collect() == []


def test_matches_asked_for_are_seldom_missed():
    least = minhash.least_matches(85, 64, 1e-8)
    rng = np.random.default_rng(1)
    assert 32 <= least <= 40 and (rng.random((100_000, 64)) < 0.85).sum(axis=1).min() >= least
    assert minhash.least_matches(100, 64) == 64


# --- spelling


def spelled(rows, min_length=5, min_count=3):
    count = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            count[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return grouped({w: n for w, n in count.items() if len(w) >= min_length and n >= min_count})


def grouped(words):
    patterns, near, form = defaultdict(set), defaultdict(set), {}
    for w in words:
        for i in range(len(w)):
            patterns["replaced", w[:i] + "*" + w[i + 1 :]].add(w)
            patterns["deleted", w[:i] + w[i + 1 :]].add(w)
    for (kind, key), some in patterns.items():
        for a in some:
            if kind == "replaced":
                near[a] |= some - {a}
            elif key in words:
                near[a].add(key)
                near[key].add(a)
    for w, n in words.items():
        most = max((words[x] for x in near[w]), default=0)
        if most >= 2 * n:
            form[w] = min(x for x in near[w] if words[x] == most)

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def test_spelling_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_spelling"](spark, SMALL).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = spelled(rows)
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert sum(form is not None for _, form, *_ in want) > 1000


@pytest.mark.parametrize("frequent", [1, 20, 5_000])
def test_near_words_whatever_the_dictionary(spark, frequent):
    """Few letters, all lengths from two, repeated letters and chains; no frequent gram, some, nearly all."""
    rng = random.Random(frequent)
    words = {"".join(rng.choice("aabé") for _ in range(rng.randrange(2, 13))): rng.randrange(1, 500) for _ in range(900)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = {(r["a"], r["b"]) for r in spelling.near_words(table, frequent=frequent).select("a", "b").collect()}
    want = {w: near for w, _, _, _, near, _ in grouped(words)}
    got = Counter(w for pair in pairs for w in pair)
    assert len({frozenset(p) for p in pairs}) == len(pairs) and {w: got[w] for w in want} == want


def test_spelling_chains_and_ties(spark):
    words = {"aaaaa": 1, "aaaab": 2, "aaabb": 4, "aabbb": 8, "abbbb": 16, "abbbc": 16, "abbbx": 8, "zzzzz": 3, "zzzz": 9, "yyyyy": 5}
    got = spelling.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert set(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect())) == grouped(words)


def test_spelling_odd_rows(spark, odd):
    text = "Abcde abcde, ABCDE abcdf abc×ßÀ " * 3 + "a" * 5_000
    rows = [(r[0], r[1]) for r in ODD] + [(8, text), (8, text), (None, text)]
    docs = odd.unionByName(spark.createDataFrame([(8, text, "c"), (8, text, "c"), (None, text, "c")], odd.schema))
    got = spelling.document_spelling(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert set(map(tuple, got)) == spelled(rows) and len(got) == 4
    assert spelling.document_spelling(odd.limit(0)).collect() == []


# --- whitening


def whitened(rows, k=4):
    """(deviations by row, whitened up to sign, shares of variance) by a dense eigenvalue problem."""
    x = np.floor(256 * np.array(rows, float))
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - fit.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return ((n * x - sums) ** 2).sum(axis=1), (x - fit.mean(axis=0)) @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum(), n


def compared(got, ids, rows, k):
    deviation, want, share, n = whitened(rows, k)
    got = got.toPandas().sort_values(["vec_id", "component"])
    assert len(got) == len(rows) * k and (got["n"] == n).all() and got["certified"].all()
    order = np.argsort(ids, kind="stable")
    mine = got["whitened"].to_numpy().reshape(-1, k)
    sign = np.sign((mine * want[order]).sum(axis=0))
    assert np.allclose(mine * sign, want[order], rtol=0, atol=1e-8)
    assert got["deviation"].to_numpy().reshape(-1, k)[:, 0].tolist() == deviation[order].astype(np.int64).tolist()
    assert np.allclose(got["explained"].to_numpy().reshape(-1, k)[0], share, rtol=1e-9) and got["identity_error"].max() < 1e-9
    assert got["identity_error"].nunique() == 1


def test_whitening_query_equals_dense_solution(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    compared(QUERIES["op13_whitening"](spark, SMALL), [r[0] for r in table], [r[1] for r in table], 4)


def test_whitening_weighs_copies_once_and_copes_with_close_eigenvalues(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 12)) * np.array([3, 2.999, 2.9, 1, 1, 1, 0.5, 0.5, 0.1, 0.1, 1e-2, 1e-2])
    rows = np.concatenate([base, np.repeat(base[:1], 200, axis=0)]).tolist()
    docs = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    compared(whitening.whiten(docs, k=3, guard=2, degree=6), list(range(len(rows))), rows, 3)


def test_whitening_odd_rows(spark):
    good = [(i, [float(i % 7), float(i % 5) / 3, 1.0]) for i in range(40)] + [(None, [1.0, 2.0, 3.0]), (3, [0.0, 0.0, 0.0])]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [float("nan"), 1.0, 1.0]), (53, [float("inf"), 1.0, 1.0]), (54, []), (55, [1.0]), (56, [1e30, 1.0, 1.0])]
    shape = "vec_id long, embedding array<double>, component string"
    docs = spark.createDataFrame([(a, b, "x") for a, b in good + bad], shape)
    got = whitening.whiten(docs, k=4).toPandas()
    # Three dimensions have three components at most.
    assert Counter(got["component"]) == {1: 42, 2: 42, 3: 42} and got["whitened"].notna().all()
    assert set(got["vec_id"].dropna()) == set(range(40)) and (got["vec_id"] == 3).sum() == 6
    assert whitening.whiten(docs.limit(0)).collect() == [] == whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "x")] * 3, shape)).collect()
    # Sums beyond a long: the deviation is null, or exact where it fits.
    far = spark.createDataFrame([(i, [float(i) * 1e6, 0.5 * (i % 3)], "x") for i in range(8)], shape)
    values = {r["vec_id"]: r["deviation"] for r in whitening.whiten(far, k=1).collect()}
    x = np.array([[int(256e6) * i, int(np.floor(128.0 * (i % 3)))] for i in range(8)], object)
    exact = {i: sum((8 * v - s) ** 2 for v, s in zip(x[i], x.sum(axis=0))) for i in range(8)}
    assert values == {i: v if v < 2**63 else None for i, v in exact.items()} and None in values.values() and any(values.values())
