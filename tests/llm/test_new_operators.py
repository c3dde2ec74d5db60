"""Toxicity, the filter audit and periodic runs against brute-force versions, with the defined edge cases."""

import hashlib
import random
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import filter_audit, periodic, queries, toxicity

ID_TEXT = "doc_id long, text string, source string, `row` string, `runs` int, `mask` int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 1, 2) for i, t, s in rows], ID_TEXT)


@pytest.fixture(scope="module")
def word_texts():
    rng = random.Random(3)
    out = [None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "x a b a b a b a b y", "é é é é é é\x0bé", "A a A a A a A a", "a　a a　a"]
    for _ in range(60):
        words = [rng.choice("abc") for _ in range(rng.randrange(1, 90))]
        turn = [rng.choice("abcd") for _ in range(rng.randrange(1, 12))]
        at = rng.randrange(len(words))
        out.append(rng.choice([" ", "\n", "  "]).join(words[:at] + turn * rng.randrange(0, 9) + words[at:]))
    return out


def brute_runs(words):
    n, found = len(words), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                stretch = words[i : i + length]
                if not any(all(stretch[k] == stretch[k + p] for k in range(length - p)) for p in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_kept(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


@pytest.mark.parametrize("whole_bytes", [1 << 16, 40])
def test_runs_equal_brute_force(spark, word_texts, whole_bytes, monkeypatch):
    monkeypatch.setattr(periodic, "WORK", 300)  # several ranges of lags for one document
    docs = table(spark, [(i if i % 5 else None, t, "s") for i, t in enumerate(word_texts)] * 2)
    got = sorted((r["row"]["doc_id"] or -1, r["row"]["text"] or "", [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.runs(docs, whole_bytes=whole_bytes).collect())
    want = []
    for i, t in enumerate(word_texts):
        found = brute_runs(split(t))
        want += [(i if i % 5 else -1, t or "", found, brute_kept(split(t), found))] * 2
    assert got == sorted(want)
    assert periodic.runs(docs.limit(0)).count() == 0


def test_query_of_runs(spark, word_texts, tmp_path):
    table(spark, [(i, t, "s") for i, t in enumerate(word_texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op13_periodic(spark, str(tmp_path)).collect()}
    assert len(got) == len(word_texts)
    changed = 0
    for i, t in enumerate(word_texts):
        words = split(t)
        n, h = len(words), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            changed += 1
        found = brute_runs(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(brute_kept(words, found).encode()).hexdigest()
    assert changed > 3


def test_a_long_document_is_dealt_by_lags(spark):
    rng = random.Random(1)
    words = [rng.choice("abcdefgh") for _ in range(4000)]
    words[1000:3000] = (words[1000:1400] * 5)[:2000]
    words[10:40] = ["z"] * 30
    docs = table(spark, [(1, " ".join(words), "s")])
    row = periodic.runs(docs, whole_bytes=100).first()
    found = periodic.smallest_periods(periodic.runs_of_lags(periodic.word_numbers([w.encode() for w in words]), range(1, 1001)))
    assert [tuple(r) for r in row["runs"]] == found == [r for r in brute_runs_fast(words)]
    assert (10, 30, 1) in found and any(q == 400 and n >= 2000 for _, n, q in found)


def brute_runs_fast(words):
    """Every lag compared in full, the filter of periods by its definition."""
    a = np.array([ord(w) for w in words])
    for s, n, q in sorted(
        ((s, e - s + q, q) for q in range(1, len(a) // 4 + 1) for s, e in stretches(a[q:] == a[:-q]) if e - s + q >= max(6, 4 * q)), key=lambda r: (r[0], r[2])
    ):
        part = a[s : s + n]
        if not any((part[p:] == part[:-p]).all() for p in range(1, q)):
            yield s, n, q


def stretches(same):
    edges = np.flatnonzero(np.diff(np.r_[0, same.astype(int), 0]))
    return zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)


# --- filter audit --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def audited():
    rng = random.Random(7)
    base = ["", "word " * 300, "A B C", "a#b", " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i % 90}" for i in range(250)) + " |", None, "x" * 3000]
    rows = [(rng.randrange(400), rng.choice(base) if rng.random() < 0.7 else f"text {rng.randrange(50)} #" * rng.randrange(1, 90), rng.choice(["p", "p", "q", None])) for _ in range(300)]
    rows += [(None, "word " * 300, "q"), (None, None, None)] + [(9, "same", "p")] * 3 + [(8, "same", "q")] * 2
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 400, 2)] + [(8, 1, 0), (None, 1, 1)]
    return rows, labels


def brute_audit(rows, labels):
    out, failing = {}, []
    quality = {i: max(q for j, q, _ in labels if j == i) for i, _, _ in labels if i is not None}
    toxic = {i: max(t for j, _, t in labels if j == i) for i, _, t in labels if i is not None}
    for i, t, part in rows:
        t = t or ""
        words = split(t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        failing.append((part or "", {k for k, v in fails.items() if v}, quality.get(i) == 1, toxic.get(i) == 1))
    for part in {p for p, _, _, _ in failing}:
        own = [f for f in failing if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(range(len(own)))
            for step, f in enumerate(order, 1):
                removed = [k for k in left if f in own[k][1]]
                redundant = sum(f in x[1] for x in own) - len(removed)
                left = [k for k in left if f not in own[k][1]]
                shapley[f] += len(removed)
                out[part, "".join(order), step] = (len(left), len(removed), redundant, sum(x[1] == {f} for x in own), sum(own[k][2] for k in removed), sum(own[k][3] for k in removed))
        for (p, order, step), numbers in list(out.items()):
            if p == part:
                out[p, order, step] = (*numbers[:6], shapley[order[step - 1]])
    return out


@pytest.mark.parametrize("case", ["plain", "collisions", "hot"])
def test_filter_audit_equals_brute_force(spark, audited, case, monkeypatch):
    rows, labels = audited
    if case == "collisions":
        monkeypatch.setattr(filter_audit, "fingerprint", lambda raw: len(raw) % 3)
        monkeypatch.setattr(filter_audit, "HELD_BYTES", 500)
    if case == "hot":
        monkeypatch.setattr(filter_audit, "HOT_ROWS", 5)
    docs = table(spark, rows).repartition(7)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    if case == "hot":
        assert filter_audit._planned(docs, "text")[1]
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.audit(docs, known).collect()}
    assert got == brute_audit(rows, labels)


def test_filter_audit_sql_and_empty_table(spark, audited, tmp_path):
    rows, labels = audited
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = queries.op12_filter_audit(spark, str(tmp_path))
    want = con.execute(queries.ORACLES["op12_filter_audit"])
    assert [c[0] for c in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert filter_audit.audit(table(spark, rows).limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


# --- toxicity ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic_texts():
    rng = random.Random(11)
    plain = ["".join(rng.choice("aeiou") + rng.choice("bcdfgklmnprst") for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    bad = ["gruzzwort", "schmakeln", "dreckling"]
    texts, toxic = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        toxic.append(i % 6 == 0)
        if toxic[-1]:
            for _ in range(max(1, len(words) // 50)):
                words[rng.randrange(len(words))] = rng.choice(bad)
        texts.append(" ".join(words))
    return texts, toxic


def scores_of(spark, texts, labels, more=()):
    docs = table(spark, [(i, t, "s") for i, t in enumerate([*texts, *more])])
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    return {r["row"]["doc_id"]: r["score"] for r in toxicity.scored(docs, known).collect()}


def test_toxicity_learns_words_and_misspellings(spark, toxic_texts):
    texts, toxic = toxic_texts
    more = ["", None, "the dreckl1ng was here and nothing else", " ".join(texts[1].split()[:7]), " ".join([*texts[1].split()] * 400 + ["gruzzwort", "schmakeln"])]
    labels = [(i, int(t)) for i, t in enumerate(toxic)]
    got = scores_of(spark, texts, labels, more)
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= toxicity.THRESHOLD) == toxic[i] for i in held) >= 0.98 * len(held)
    n = len(texts)
    assert got[n] == got[n + 1] < 0.5
    assert got[n + 2] >= 0.7 > got[n + 3]
    assert got[n + 4] >= 0.7  # two words in a document of thousands
    # Labels of held-out rows change nothing.
    flipped = [(i, 1 - y if i in set(held) else y) for i, y in labels]
    assert scores_of(spark, texts, flipped, more) == got


def test_toxicity_scores_equal_a_plain_loop(spark, toxic_texts):
    texts, toxic = toxic_texts
    docs = table(spark, [(i, t, "s") for i, t in enumerate(texts)])
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int"))
    odds = toxicity.folded(model)

    def bucket(gram):
        h = 0
        for k, c in enumerate(gram):
            h = ord(c) if k == 0 else (h * 0x01000193 + ord(c)) % (1 << 32)
        return ((h + len(gram)) * 0x9E3779B1 % (1 << 32)) >> (32 - 18)

    def plain(text):
        words = (text or "").split()
        best = None
        for at in range(0, len(words), toxicity.PASSAGE):
            rows = []
            for w in words[at : at + toxicity.PASSAGE]:
                w = " " + "".join(c.lower() if "A" <= c <= "Z" else c for c in w) + " "
                rows += [model["embedding"][bucket(w[i : i + n])] for n in (3, 4, 5) for i in range(len(w) - n + 1)]
            e = np.exp(np.mean(rows, axis=0) @ model["softmax"] + model["bias"])
            best = max(best or 0, e[1] / e.sum())
        return model["empty"] if best is None else best

    tried = [*texts[:30], "", "A", "Gruzzwort GRUZZWORT", "é gruzzwört\n\n schmakeln", "  x  "]
    assert np.allclose(toxicity.scores(odds, tried), [plain(t) for t in tried], atol=1e-9)
    assert np.allclose(toxicity.scores(odds, tried[::-1])[::-1], [plain(t) for t in tried], atol=1e-9)


def test_toxicity_without_labels_or_rows(spark, toxic_texts):
    texts, _ = toxic_texts
    assert set(scores_of(spark, texts[:3], []).values()) == {0.5}
    empty = table(spark, [(1, "a", "s")]).limit(0)
    assert toxicity.scored(empty, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0
    twice = table(spark, [(1, texts[0], "s"), (1, texts[0], "t"), (None, texts[0], "s")])
    got = toxicity.scored(twice, spark.createDataFrame([(1, 1), (None, 1)], "doc_id long, toxic int")).select("row.doc_id", "score", F.col("row.mask")).collect()
    assert len(got) == 3 and len({r["score"] for r in got}) == 1
