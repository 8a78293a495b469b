"""The operators of tokens, fingerprints and vectors against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest

from sparklayout.llm import fingerprints, hard_negatives, queries, token_alignment

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, n_a string, fingerprint string, id long"
ODD = [
    None, "", " ", "  ", "a", "\n", "a\n\n b", "a\t\n b", "x\x1c\n y!", "▁x", "a ▁ b", "<|endoftext|> </s> <s>", "=" * 300, "日本語テキスト 中文", "éé ﬁ",
    "🙂🙂 🙂", "a\r\n b;\r\n", "　x 　y", "don't  we'll", "ab" * 3000, " lead", "trail ", "trail\n", " \n \n x", "\x00\x01", "#" * 700 + " " * 300 + "z", "1234567 89,00", "  a \n",
    "the quick brown fox " * 3000,
]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "n", "f", 1) for i, t in rows], DOCS).repartition(3)


def sample(spark, n):
    found = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(n)
    return [tuple(r) for r in found.collect()] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "hello world")] + [(5, "hello world")] * 2


def same_rows(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("piece", [1, 7, 128])
def test_merge_by_diagonals_finds_all_common_ends(piece):
    rng = np.random.default_rng(piece)
    for _ in range(100):
        n = int(rng.integers(2, 400))
        a, b = (np.append(np.sort(rng.choice(np.arange(1, n), rng.integers(0, n), replace=False)), n).astype(np.int64) for _ in range(2))
        in_a, in_b = token_alignment.common_ends(a, b, piece)
        both = np.intersect1d(a, b)
        assert np.array_equal(in_a, np.searchsorted(a, both, "right")) and np.array_equal(in_b, np.searchsorted(b, both, "right"))
    none = np.empty(0, np.int64)
    assert [len(x) for x in token_alignment.common_ends(none, none)] == [0, 0]


def _aligned(docs):
    """Whole texts by the libraries, ends merged token by token, links counted pair by pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    plain = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    byte_of = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}

    def piece(p):
        found = re.fullmatch("<0x(..)>", p)
        return bytes([int(found[1], 16)]) if found else p.replace("▁", " ").encode()

    every = []
    for _, text in docs:
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        a_bytes = [bytes(byte_of[c] for c in first.id_to_token(i)) for i in a]
        b_bytes = [piece(second.id_to_piece(i)) for i in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            every.append(None)
            continue
        a_ends, b_ends = (np.cumsum([len(x) for x in y]).tolist() for y in (a_bytes, b_bytes))
        cuts, groups, i, j = set(a_ends) & set(b_ends), [], 0, 0
        for cut in sorted(cuts):
            k, m = a_ends.index(cut, i) + 1, b_ends.index(cut, j) + 1
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        every.append((len(a), len(b), groups))
    held = Counter(p for x in every if x for p in {(a, b) for g in x[2] for a in g[0] for b in g[1]})
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    for (d, _), x in zip(docs, every, strict=True):
        if x is None:
            yield d, 0, 0, 0, 0, 0, 0, ""
            continue
        links = [(a, b) for g in x[2] for a in g[0] for b in g[1]]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in x[2])
        yield d, x[0], x[1], len(x[2]), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("block", [1, 1 << 30])
def test_aligned_tokens_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", block)
    docs = sample(spark, 60)
    found = token_alignment.align_tokens(docs_of(spark, docs), A, B)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    same_rows(found.collect(), _aligned(docs))
    assert token_alignment.align_tokens(docs_of(spark, docs).limit(0), A, B).count() == 0


def test_wide_groups_and_chunks_that_spell_something_else():
    pair = token_alignment.Pair(A, B)
    text = "=-" * 400
    plain, token_alignment.WIDE = pair.align([text, "a ▁ b", "x"]), 0
    try:
        wide = pair.align([text, "a ▁ b", "x"])
    finally:
        token_alignment.WIDE = 1024
    for k in ("n_a", "n_links", "doc", "code", "times"):
        assert np.array_equal(plain[k], wide[k]), k
    assert plain["n_a"][1] == 0 and plain["n_a"][2] > 0


def test_registered_alignment_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    same_rows(queries.queries()["op11_token_alignment"](spark, folder).collect(), _aligned(docs))


def _likeness(a, b):
    weights = [{w: n * len(w) for w, n in Counter(re.findall(r"\w+|[^\w\s]", t.lower())).items()} for t in (a, b)]
    words = weights[0].keys() | weights[1].keys()
    total = sum(max(x.get(w, 0) for x in weights) for w in words)
    return sum(min(x.get(w, 0) for x in weights) for w in words) / total if total else 1.0


def test_samples_meet_as_often_as_the_weights_are_alike():
    rng = random.Random(5)
    words = [f"word{'x' * rng.randrange(9)}{i}" for i in range(400)]
    sampler = fingerprints.Sampler(256)
    texts = [" ".join(rng.choices(words[k : k + 60], k=rng.randrange(20, 200))) for k in range(0, 200, 4)]
    made = sampler.fingerprints(texts)
    found = [(fingerprints.same(made[i], made[j]), _likeness(texts[i], texts[j])) for i in range(50) for j in range(i)]
    error = np.array([x - y for x, y in found])
    assert abs(error.mean()) < 0.01 and np.sqrt((error**2).mean()) < 1.3 * np.sqrt(np.mean([y * (1 - y) / 256 for _, y in found]))


def test_fingerprints_do_not_depend_on_company(monkeypatch):
    texts = [" ".join(f"w{(i * k) % 97}" for i in range(200 + k)) for k in range(1, 12)] + ["", "...", "one", "Ünï cödé 中文"]
    alone = [fingerprints.Sampler(64).fingerprints([t])[0] for t in texts]
    assert fingerprints.Sampler(64).fingerprints(texts * 2) == alone * 2
    monkeypatch.setattr(fingerprints, "TERMS", 7)
    monkeypatch.setattr(fingerprints, "TOGETHER", 31)
    assert fingerprints.Sampler(64).fingerprints(texts) == alone
    assert fingerprints.same(b"", b"") == 1.0 and fingerprints.same(b"", alone[0]) == 0.0


def test_edits_and_neighbours_equal_one_by_one(spark):
    for rows in (sample(spark, 150) + [(-5, None), (-4, "")], [(1, "a b c")], [], [(1, "a b")] * 3):
        df = docs_of(spark, rows)
        hashes = dict(map(tuple, df.selectExpr("text", "xxhash64(text)").distinct().collect()))
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
        sampler, want = fingerprints.Sampler(64), []
        for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
            text, after = text or "", after or ""
            half = len(text) // 2
            changed = text[: len(text) - half] + after[:half]
            own, new, following = sampler.fingerprints([text, changed, after])
            want.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.hex(), new.hex(), fingerprints.same(own, new), fingerprints.same(own, following)))
        same_rows(fingerprints.fingerprint_edits(df).collect(), want)


def test_registered_fingerprints_tell_edits_from_other_texts(spark):
    got = queries.queries()["op12_fingerprints"](spark, "/root/testdata/sf0.01").where("n_chars >= 400").toPandas()
    assert (got["near_edited"] > got["near_next"]).mean() > 0.99 and got["near_edited"].median() > 0.3
    docs = docs_of(spark, sample(spark, 5)).drop("fingerprint")
    both = fingerprints.fingerprint(docs).alias("a").join(fingerprints.fingerprint(docs, name="other").alias("b"), "doc_id")
    for r in both.select("fingerprint", "other", fingerprints.likeness(both["fingerprint"], both["other"]).alias("like")).collect():
        assert r["like"] == fingerprints.same(bytes.fromhex(r["fingerprint"]), bytes.fromhex(r["other"]))


def _mined(rows, every):
    known = {}
    for i, label, vector in rows:
        if None in (i, label, vector) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        q = [math.floor(256 * x) for x in vector]
        known[i] = min(known.get(i, (label, q)), (label, q))
    for a, (label, q) in known.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(q, other, strict=False)), i, m) for i, (m, other) in known.items() if i != a)
        for s, p, _ in [x for x in scores if x[2] == label][:5]:
            for k, (t, n, _) in enumerate([x for x in scores if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]):
                yield a, p, k + 1, n, -s, -t


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "GROUP_ROWS", 3)
    monkeypatch.setattr(hard_negatives, "STEP", 2)
    rng = random.Random(1)
    rows = [(i, rng.randrange(3), [rng.choice([-1.0, 0.5, 0.25, 2.0, rng.gauss(0, 1)]) for _ in range(rng.choice([4, 12, 12, 12]))]) for i in range(150)]
    rows += [(i, 1, [0.5] * 12) for i in range(150, 200)]  # a third of a label's rows are equal
    rows += [(200, None, [1.0]), (201, 1, None), (202, 1, [None, 1.0]), (203, 1, [math.nan]), (204, 1, [math.inf]), (205, 2, []), (None, 1, [1.0])]
    rows += [(30, 2, [9.0]), (31, 0, [0.5]), (31, 0, [0.5])] + [rows[7]] * 5
    df = spark.createDataFrame([(*r, "x", 0, "y") for r in rows], "vec_id long, label int, embedding array<double>, rank string, id long, block string").repartition(5)
    found = hard_negatives.mine_hard_negatives(df, lambda i: i % 10 == 0)
    want = list(_mined(rows, 10))
    same_rows(found.collect(), want)
    assert len(want) > 500 and hard_negatives.mine_hard_negatives(df.limit(0), lambda i: i % 10 == 0).count() == 0
    large = spark.createDataFrame([(i, 0, [1e9] * 4) for i in range(3)], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        hard_negatives.mine_hard_negatives(large, lambda i: i % 10 == 0).count()


def test_bounds_rule_candidates_out_before_the_last_dimension():
    rng = np.random.default_rng(2)
    block = SimpleNamespace()
    matrix = rng.integers(-40, 40, (500, 32))
    matrix[:5, :4] = 4000
    block.dims, block.least, block.greatest = list(matrix.T.copy()), matrix.min(0), matrix.max(0)
    anchor, sizes = np.array([100] * 4 + [1] * 28), []
    keep = hard_negatives._best(5)
    places, scores = hard_negatives.scan(anchor, block, np.arange(500), lambda low, high: sizes.append(len(low)) or keep(low, high))
    assert sizes[0] == 500 and sizes[1] == 5 and sorted(places.tolist()) == [0, 1, 2, 3, 4]
    assert np.array_equal(scores, matrix[places] @ anchor)


def test_hard_negatives_send_nothing_through_the_driver(spark):
    """Groups of anchors, repeated for every shard, were broadcast, since Spark guesses their size before they are repeated."""
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, rng.normal(size=4).tolist()) for i in range(300)]
    found = hard_negatives.mine_hard_negatives(spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>"), lambda i: i % 10 == 0)
    assert found.count() > 100
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_grid_of_blocks_and_anchors():
    assert hard_negatives._grid(48, 76, 3077) == (48, 1)
    shards, parts = hard_negatives._grid(600, 3662, 150_000)
    assert (shards, parts) == (245, 3) and hard_negatives._grid(600, 3662, 1_500_000)[1] == 23  # 65,536 anchors a part
    assert hard_negatives._grid(8, 0, 0) == (1, 1)
    for x in (np.array([], np.int64), np.array([-3, 5]), np.array([40_000]), np.array([-(1 << 40), 7])):
        assert hard_negatives._unpacked(hard_negatives._packed(x)).tolist() == x.tolist()
