"""Merkle manifest, periodic runs and context trees: against brute force, and with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import context_tree, merkle_manifest, periodic_runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, block long, pos long, n long, hash string, item string, runs string, gram long, value double"


def table(spark, rows):
    """documents with columns whose names the operators use inside; rows are (doc_id, text, lang)."""
    return spark.createDataFrame([(i, t, lang, None if i is None else f"s{i % 3}", None if t is None else len(t), 1, 2, 3, 4, "h", "x", "r", 5, 0.5) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(3)
    line = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(0, None, None), (1, "", "en"), (2, " \n\t ", "en"), (3, "One", ""), (4, line(6000), "en"), (5, "ab " * 3000, "fr")]
    rows += [(i, f"{line(20)} X Y Z {'p q r ' * (i % 9)}{line(15)}", ["en", "fr", None, "é"][i % 4]) for i in range(6, 130)]
    rows += [(7, "the same id", "fr"), (130, "equal Rows", "en"), (130, "equal Rows", "en"), (None, "no id", "en"), (None, None, None), (131, "naïve Émile — " * 4, "de")]
    return rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(hashes):
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for k in range(len(paths)):
            first = at[k] // 8 * 8
            paths[k].append(("".join(hashes[first : at[k]]), "".join(hashes[at[k] + 1 : first + 8])))
            at[k] //= 8
        hashes = [sha("".join(hashes[a : a + 8])) for a in range(0, len(hashes), 8)]
    return hashes[0], paths


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, source, lang, n_chars, text)."""
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = defaultdict(list)
    for r in rows:
        low = r[4] and r[4].translate({c: c + 32 for c in range(65, 91)})
        own, changed = sha("".join(map(value, r))), sha("".join(map(value, (*r[:4], low))))
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        by[r[2]].append(((r[0] is not None, r[0] or 0, own), r[0], own, changed if tampered else own))
    trees = {k: brute_tree([x[2] for x in sorted(v)]) for k, v in by.items()}
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    root, above = brute_tree([trees[k][0] for k in order]) if order else (None, [])
    out = []
    for k, more in zip(order, above, strict=True):
        for (_, i, own, start), path in zip(sorted(by[k]), trees[k][1], strict=True):
            x = start
            for left, right in path + more:
                x = sha(left + x + right)
            out.append((i, own, trees[k][0], root, sha("".join(a + b for a, b in path + more)), x, x == root))
    return out


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_against_brute_force(spark, odd_rows, levels, monkeypatch):
    """With blocks of eight leaves there are up to three rounds of swaps, with ragged ends; with blocks of 512, none."""
    monkeypatch.setattr(merkle_manifest, "LEVELS", levels)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 8**levels)
    docs = table(spark, odd_rows + [(1000 + i, f"T{i}", "en") for i in range(600)])
    got = sorted(map(repr, map(tuple, merkle_manifest.digest(docs).collect())))
    want = brute_manifest([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()])
    assert got == sorted(map(repr, want))
    assert {w[-1] for w in want} == {True, False}


def test_manifest_of_many_languages(spark, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "FEW", 5)  # joins without broadcasts
    docs = table(spark, [(i, "x", f"l{i % 150}") for i in range(400)])
    got = sorted(map(tuple, merkle_manifest.digest(docs).collect()))
    assert got == sorted(brute_manifest([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]))


def test_manifest_of_little(spark):
    assert merkle_manifest.digest(table(spark, [])).count() == 0
    (r,) = merkle_manifest.digest(table(spark, [(0, None, None)])).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == sha("")
    kept = merkle_manifest.manifest(table(spark, [(1, "a", "x"), (2, "b", "x")]), ["text"])
    assert sorted((r.item, r.leaf, len(r.proof), r.verified) for r in kept.collect()) == [(1, sha("1:a"), 1, True), (2, sha("1:b"), 1, True)]


def test_agreement_of_places():
    rng = random.Random(4)
    for letters in (1, 2, 4, 30):
        s = np.array([100, *(rng.randrange(letters) for _ in range(400)), 101], np.int32)
        i, j = np.array([rng.sample(range(len(s)), 2) for _ in range(1500)]).T
        want = [next(k for k in range(len(s)) if s[a + k] != s[b + k]) if max(a, b) < len(s) - 1 else 0 for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        assert periodic_runs.agreement(periodic_runs.grammar(s), i, j).tolist() == want


def test_runs_of_words():
    rng = random.Random(6)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 6)):
            d = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.choice([0, 1, 11, 12, 60, 150]))]
            docs.append(d + d[: rng.randrange(len(d) + 1)] + d if rng.random() < 0.4 else d)
        for d, told in zip(docs, periodic_runs._told(docs)[0], strict=True):
            assert [tuple(x) for x in told.tolist()] == periodic_runs.brute(d)


def test_chunks_of_grid_places(monkeypatch):
    monkeypatch.setattr(periodic_runs, "CHUNK", 50)
    words = [b"a", b"b", b"a"] * 30 + [b"c", b"d"] * 8
    assert [tuple(x) for x in periodic_runs._told([words, words[5:]])[0][0].tolist()] == periodic_runs.brute(words)


def test_runs_query_against_brute_force(spark, odd_rows):
    got = sorted(map(repr, map(tuple, periodic_runs.digest(table(spark, odd_rows)).collect())))
    want = []
    for i, t, _ in odd_rows:
        words = (t or "").encode().split()
        n, h = len(words), 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = periodic_runs.brute(words)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        told = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(told), sha(b" ".join(w for k, w in enumerate(words) if k not in gone).decode())))
    assert got == sorted(map(repr, want))
    assert sum(w[1] > 0 for w in want) > 10
    assert periodic_runs.digest(table(spark, [])).count() == 0


def test_collapsed_texts(spark):
    docs = table(spark, [(1, "so " + "on and " * 9 + "end", None), (2, None, None), (3, "short  text", None)])
    assert {r.id: r.text for r in periodic_runs.collapsed(docs).collect()} == {1: "so on and end", 2: "", 3: "short text"}


def brute_scores(texts, learn, depth):
    """log10 probability of each text by its own trees of dictionaries."""
    grams = lambda t: [((b"\xff" * depth + t)[k : k + depth][::-1], c) for k, c in enumerate(t + b"\xff")]
    low = [t.lower() for t in texts]
    counts = defaultdict(lambda: [0, 0])
    for t, is_learned in zip(low, learn, strict=True):
        for context, c in grams(t) if is_learned else []:
            for k in range(8):
                for d in range(depth + 1):
                    counts[context[:d], 1 << k | c >> (8 - k)][c >> (7 - k) & 1] += 1
    below, own, log = defaultdict(float), {}, {}
    for context, node in sorted(counts, key=lambda x: -len(x[0])):
        a, b = counts[context, node]
        own[context, node] = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        x = own[context, node]
        log[context, node] = x if len(context) == depth else np.logaddexp(x, below[context, node]) - math.log(2)
        if context:
            below[context[:-1], node] += log[context, node]

    def bit(context, node, b):
        p = None
        for d in range(depth, -1, -1):
            key = context[:d], node
            if key in counts:
                estimate = (counts[key][b] + 0.5) / (sum(counts[key]) + 1)
                w = 1.0 if p is None else math.exp(own[key] - math.log(2) - log[key])
                p = w * estimate + (1 - w) * (p or 0)
        return 0.5 if p is None else p

    return [sum(math.log10(bit(context, 1 << k | c >> (8 - k), c >> (7 - k) & 1)) for context, c in grams(t) for k in range(8)) for t in low]


@pytest.mark.parametrize(("depth", "block"), [(3, 8_000_000), (4, 300), (6, 2000)])
def test_scores_against_brute_force(spark, odd_rows, depth, block, monkeypatch):
    monkeypatch.setattr(context_tree, "BLOCK_BYTES", block)
    monkeypatch.setattr(context_tree, "GROUP", 200)
    monkeypatch.setattr(context_tree, "CHUNK", 500)
    rows = [(i, t[:700] if t else t, lang) for i, t, lang in odd_rows][::2]
    docs = table(spark, rows)
    got = sorted((r.id is not None, r.id or 0, round(r.score, 6)) for r in context_tree.scores(docs, F.col("doc_id") % 4 != 0, depth=depth).collect())
    told = brute_scores([(t or "").encode() for _, t, _ in rows], [i is not None and i % 4 != 0 for i, _, _ in rows], depth)
    want = sorted((i is not None, i or 0, s) for (i, _, _), s in zip(rows, told, strict=True))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-4)


def test_bytes_after_a_context_sum_to_one():
    data = b"abracadabra abracadabra"
    windows = context_tree.Windows(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 3)
    gram, n = context_tree._summed(windows.distinct())
    levels = context_tree.tree(gram, n, 3, 0)
    for context in (gram[0] >> 8, gram[7] >> 8, 12345):
        every = (np.int64(context) << 8) + np.arange(256)
        assert (10 ** context_tree.log10_of(every, levels, 3)).sum() == pytest.approx(1)


def test_base_scores(spark, odd_rows):
    rows = {r.doc_id: r for r in context_tree.digest(table(spark, [r for r in odd_rows if r[0] not in (None, 7, 130)])).collect()}
    texts = {i: (t or "").encode().lower().split() for i, t, _ in odd_rows if i in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    learned = defaultdict(int)
    for i, words in texts.items():
        for w in [*words, None] if not held[i] else []:
            learned[w] += 1
    total = sum(learned.values())
    for i, words in texts.items():
        r, every = rows[i], [*words, None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(every), sum(learned.get(w, 0) > 0 for w in every), total)
        assert r.base_score == pytest.approx(sum(math.log10((learned.get(w, 0) + 0.1) / (total + 0.1 * (len(learned) + 1))) for w in every))


def test_scores_of_little(spark):
    assert context_tree.digest(table(spark, [])).count() == 0
    (r,) = context_tree.scores(table(spark, [(1, "ab", None)]), F.lit(False)).collect()
    assert r.score == pytest.approx(-24 * math.log10(2)) and (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (2, 0, 0, 0.0)


def test_held_out_texts_are_told_better_than_by_bytes_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = context_tree.digest(docs).where("held_out").collect()
    data = b"".join((r.text or "").lower().encode() + b"\xff" for r in docs.collect())
    share = np.bincount(np.frombuffer(data, np.uint8)) / len(data)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    bits = -sum(r.score for r in rows) * math.log2(10) / sum(r.n_bytes + 1 for r in rows)
    assert rows and bits < 0.75 * entropy
