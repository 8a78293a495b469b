"""Operators of the llm subpackage: odd inputs, and brute-force versions where SQL can't express them."""

from __future__ import annotations

import base64
import hashlib
import math
import itertools
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparklayout.llm import (
    byte_bpe,
    chat_format,
    decontaminate,
    exact_dedup,
    html_extract,
    language_id,
    ngram_join,
    quality_model,
    token_files,
    url_filter,
)

P = pytest.importorskip("public_tokenizers")
RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
#: A column of the input that has the name of an output column.
DOCS = "doc_id long, text string, lang string, keep_id string, n_tokens string, score string, start string, component_id string"
LONG = "the quick brown fox jumps over the lazy dog " * 5000
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "Hello  world"), (5, "hello world"), (6, "Hello world"), (6, "Hello world"), (None, "x y"), (7, LONG), (8, "日本語 ñandú\u00a0e\u0301 \x1c\x85 !!??"), (9, "a\x00b")]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "k", "n", "s", "s", "c") for i, t in rows], DOCS).repartition(3)


def table_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: [(x is None, str(x)) for x in r])


def test_byte_bpe_equals_reference_encoder(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    noise = [(100 + i, "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 600), rng.randrange(0x4E00, 0x4F00)])) for _ in range(60))) for i in range(40)]
    got = table_of(byte_bpe.encode_documents(docs_of(spark, ODD + noise), RANKS, P.PATTERN), "doc_id", "ids", "n_tokens", "decoded_sha256", "exact")
    want = []
    for i, t in ODD + noise:
        ids = own.encode_ordinary(t or "")
        want.append((i, ",".join(map(str, ids)), len(ids), hashlib.sha256((t or "").encode()).hexdigest(), True))
    assert got == sorted(want, key=lambda r: [(x is None, str(x)) for x in r])
    assert byte_bpe.encode_documents(docs_of(spark, []), RANKS, P.PATTERN).count() == 0


def test_token_files_round_trip_and_damage(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    odd = [*ODD, (20, "hello <|endoftext|> world<|startoftext|>x <|ENDOFTEXT|>"), (21, "ΣΑΣ. İx ² don't_a's ½"), (22, "\x1ca\x1db")]
    index = token_files.write_token_files(docs_of(spark, odd), WORDS, 2)
    got = [tuple(r) for r in token_files.read_token_files(index.repartition(3)).orderBy("start").select("doc_id", "start", "n_tokens", "ids").collect()]
    start = 0
    for (i, s, n, ids), (j, text) in zip(got, sorted(odd, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (i, s, n, bytes(ids)) == (j, start, len(want), struct.pack(f"<{len(want)}I", *want))
        start += n
    assert token_files.write_token_files(docs_of(spark, []), WORDS, 2).count() == 0
    record = token_files.frame(token_files.pack(struct.pack("<2I", 5, 70_000)))
    assert token_files.unpack(token_files.unframe(record)) == struct.pack("<2I", 5, 70_000)
    for k in range(len(record)):
        with pytest.raises(ValueError):
            token_files.unframe(record[:k] + bytes([record[k] ^ 1]) + record[k + 1 :])


def test_language_profiles(spark):
    rng = random.Random(2)
    syllables = {"aa": ["ba", "do", "ki", "mu"], "bb": ["sch", "ung", "ein", "ber"], "cc": ["ção", "nh", "ões", "lho"]}
    make = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(n))
    rows = [(i, make(lang, rng.randrange(3, 60)), lang) for i, lang in enumerate(list(syllables) * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trained = language_id.train_profiles(df.where("doc_id < 60"))
    odd = spark.createDataFrame([(900, None, None), (901, "", None), (902, "12 !?", None)], df.schema)
    got = {r["doc_id"]: r for r in language_id.predict_languages(df.unionByName(odd), trained).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language_id.predict_languages(df, {}).collect()} == {"und"}
    # bundling by blocks of counted n-grams is the plain sum over places
    text = "abc abd"
    padded = [ord(c) for c in f" {text} "]
    plain = sum(language_id.bind(np.array([padded[i : i + 3]]), 256)[0].astype(int) for i in range(len(padded) - 2))
    assert np.array_equal(language_id.profiles([text], 256)[0], plain)


def test_language_id_equals_brute_force(spark):
    """Plain dictionaries of n-grams, summed place by place, against the bundled prediction; odd rows."""
    rng = random.Random(5)
    alphabet = {"aa": "abcde", "bb": "vwxyz", "cc": "aevwz"}
    rows = [(i, "".join(rng.choices(alphabet[lang] + " ", k=rng.randrange(5, 40))), lang, "x") for i, lang in enumerate(list(alphabet) * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    dims = 128
    trained = language_id.train_profiles(df, dimensions=dims)

    def vector(text):
        words = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
        padded = [ord(c) for c in f" {words} "]
        out = np.zeros(dims)
        for i in range(len(padded) - 2) if words else ():
            one = np.ones(dims)
            for k in range(3):
                one *= np.roll(language_id.letter_vector(padded[i + k], dims), 2 - k)
            out += one
        return out

    for lang, profile in trained.items():
        assert np.allclose(profile, sum(vector(t) for _, t, x, _ in rows if x == lang))
    odd = [(100, None, None, ""), (101, "  42", None, ""), (102, "a" * 200_000 + " vw", None, ""), (0, *rows[0][1:]), (0, *rows[0][1:]), (103, "日本", None, "")]
    got = language_id.predict_languages(df.unionByName(spark.createDataFrame(odd, df.schema)), trained).collect()
    assert len(got) == len(rows) + len(odd)
    texts = {i: t for i, t, *_ in [*rows, *odd]}
    for r in got:
        v = vector(texts[r["doc_id"]] or "")
        cosines = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) if v.any() else 0.0 for k, p in trained.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert r["lang_pred"] == (best if v.any() else "und") and r["score"] == pytest.approx(max(0.0, cosines[best]), abs=1e-6)
    twins = {"zz": trained["aa"], "aa": trained["aa"]}  # equal cosines: the first by name
    assert {r["lang_pred"] for r in language_id.predict_languages(df, twins).collect()} == {"aa"}
    assert language_id.train_profiles(df.limit(0)) == {} and language_id.predict_languages(df.limit(0), trained).count() == 0


def test_chat_states_and_escapes(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\[INST]", "[\\INST]", "<<SYS>><</SYS>>", "<<s>", "a\\\\b [TEXT] [/ROLE]", "", None, " lead and trail ", "[INST]\\"]
    rows = []
    for k, text in enumerate(nasty):
        rows += [(k, 0, "system", text), (k, 1, "user", text), (k, 2, "assistant", text)]
    rows += [(100, 0, "user", "a"), (101, 0, "assistant", "b"), (102, 0, "user", "a"), (102, 1, "tool", "[ROLE]x"), (103, 0, None, "q"), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    chats = chat_format.format_chats(df)
    back = {r["conv_id"]: r for r in chats.withColumn("back", chat_format.read_back(F.col("formatted"))).collect()}
    for conv in {r[0] for r in rows}:
        want = [(role, text or "") for c, _, role, text in rows if c == conv]
        assert [(x["role"], x["text"]) for x in back[conv]["back"]] == want
        assert back[conv]["n_turns"] == len(want)
        assert "".join(s["text"] for s in back[conv]["segments"]) == back[conv]["formatted"]
    assert all(back[k]["valid"] for k in range(len(nasty)))
    assert not any(back[k]["valid"] for k in (100, 101, 102, 103, None))
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_url_rules_by_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "http://com", "http://com/", "https://WWW.Example.com/en/x?y#z", "https://a.www.example.com/en/", "https://example.com/en", "https://b.example.com/en/1", "http://x.net/es/", "http://x.net/es", "http://notnet/es/", "a://b://c.com/d", "http://my host.net/es/1", "http://x\n.net/es/", "http://a.net\n/es/", "http://net /es/", "http://x.net/ es/", "http://net/fr/#", "http://x.com?q=/en/", "http://u.net/fr/\n2"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls * 2)], "page_id long, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    for i, u in enumerate(urls * 2):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        assert got[i] == (host, path, best.text if best else None, best.action if best else "allow"), u
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    # rules of equal length: block before allow; a rule without a host fits hosts without a name or that end in a dot
    rules = [url_filter.Rule("allow", "b.c", "/x/"), url_filter.Rule("block", "c", "/x/y/"), url_filter.Rule("block", "", "/e")]
    more = [(1, "http://a.b.c/x/y/"), (2, "http:///e"), (3, "http://dot./e"), (4, "http://b.c/x/"), (5, "http://c/" + "x/" * 50_000)]
    more = spark.createDataFrame([(i, u, i) for i, u in more], "page_id long, url string, rule int")
    tied = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(more, rules).collect()}
    assert tied == {1: ("c/x/y/", "block"), 2: ("/e", "block"), 3: ("/e", "block"), 4: ("b.c/x/", "allow"), 5: (None, "allow")}


@pytest.mark.parametrize("hot", [0, 400])
def test_exact_duplicates(spark, hot):
    rows = ODD + [(1000 + i, "same  text\there") for i in range(hot)]
    df = docs_of(spark, rows)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = Counter(norm(t) for _, t in rows)
    least = {n: min((i for i, t in rows if norm(t) == n and i is not None), default=None) for n in groups}
    got = table_of(exact_dedup.exact_duplicates(df), "doc_id", "keep_id", "group_size", "text_sha256")
    want = [(i, least[norm(t)], groups[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows]
    assert got == sorted(want, key=lambda r: [(x is None, str(x)) for x in r])
    assert exact_dedup.exact_duplicates(df).where("kept").count() == len(groups)
    kept = exact_dedup.drop_exact_duplicates(df)
    assert kept.columns == df.columns and kept.count() == len(groups)
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0


def _near_brute(rows):
    sets = {}
    for i, t in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(i, len(sets[i]), find(i)) for i in ids]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    shared = rng.choices(vocabulary, k=12)
    rows = [(0, None), (1, "  "), (2, "Two words"), (3, "two WORDS")]
    for i in range(10, 130):
        words = rng.choices(vocabulary, k=rng.randrange(5, 60)) + (shared if i % 2 else [])
        rows.append((i, " ".join(words)))
    base = rng.choices(vocabulary, k=80)
    for i in range(200, 260):  # copies around the limit of similarity
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(80)] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(copy)))
    got = table_of(ngram_join.near_duplicates(docs_of(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert [tuple(r) for r in got] == sorted(_near_brute(rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("crowd", [1, 10_000])
def test_last_round_alone_finds_all_links(spark, monkeypatch, crowd):
    """Without further leaders, buckets of near copies of several texts are left to the last round, as crowded ones or not."""
    monkeypatch.setattr(ngram_join, "LEADERS", ())
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    seen = []
    short = ngram_join._short_sketches
    monkeypatch.setattr(ngram_join, "_short_sketches", lambda *x: seen.append(1) or short(*x))
    rng = random.Random(4)
    base = [[f"b{k}w{i}" for i in range(120)] for k in range(3)]
    rows = []
    for i in range(90):
        words = list(base[i % 3])
        for at in rng.sample(range(120), rng.randrange(9)):
            words[at] = f"x{rng.randrange(40)}"
        words = words[: rng.randrange(80, 121)] + base[(i + 1) % 3][: rng.randrange(12)]
        rows.append((i, " ".join(words)))
    got = table_of(ngram_join.near_duplicates(docs_of(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == sorted(_near_brute(rows), key=lambda r: [(x is None, str(x)) for x in r])
    assert bool(seen) == (crowd == 1)


def test_near_duplicates_odd_inputs(spark):
    df = docs_of(spark, ODD)
    got = ngram_join.near_duplicates(df)
    assert got.count() == len(ODD)
    assert {r["component_id"] for r in got.where("doc_id in (4, 5, 6)").collect()} == {4}
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0
    kept = ngram_join.drop_near_duplicates(df)
    assert kept.columns == df.columns and 5 not in {r["doc_id"] for r in kept.collect()}


def test_repeated_rows_and_ids_with_several_texts_do_not_add_up(spark):
    """Half of the n-grams in common is no link, however often a row stands in the table."""
    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    half = [*a[:40], *b[:20]]
    rows = [(1, a)] * 30 + [(2, half)] * 30 + [(3, [*half[:59], "end"]), (4, c), (4, b), (5, b)]
    df = docs_of(spark, [(i, " ".join(words)) for i, words in rows])
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()}
    assert got == {(1, 1), (2, 2), (3, 2), (4, 4), (5, 4)}


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (0, 1, 50, 3000):
        x = rng.integers(0, 1 << 62, n)
        y = np.concatenate([x[: n // 2], rng.integers(0, 1 << 62, n // 3)])
        apart = np.bitwise_count(ngram_join.sketch(x) ^ ngram_join.sketch(y)).sum()
        assert apart <= n - n // 2 + n // 3 and (n > 50 or apart >= (n - n // 2) * 0.9)


def test_near_pair_met_in_both_orders(spark):
    """9 (100 words) and 11 (these and 30 rare ones) share three prefix keys; in one bucket 9's component is the
    largest, in the others it is not, so the last round meets the pair in both orders."""
    f, d, e = ([f"{x}{i}" for i in range(n)] for x, n in (("f", 100), ("d", 19), ("e", 19)))
    rows = [(1, [f[0], *f[3:82]]), (2, [f[1], *d]), (3, [f[1], *d[:18]]), (4, [f[2], *e])]
    rows += [(9, f), (11, [*f, *(f"rare{i}" for i in range(30))])]
    rows += [(20 + k, [*f[3:], *d, *e, *(f"own{k}_{i}" for i in range(300))]) for k in range(4)]
    df = docs_of(spark, [(i, " ".join(words)) for i, words in rows])
    salts = {r[0] for r in df.where("doc_id < 20").select(F.pmod(F.xxhash64("doc_id"), F.lit(ngram_join.SALTS))).collect()}
    assert len(salts) == 6  # nobody leads another in round 1 but the least of a bucket
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(df, words=1).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 9: 1, 11: 1, **{20 + k: 20 + k for k in range(4)}}


def _least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(row[j - 1] + (c != d), row[j] + 1, now[-1] + 1))
        row = now
    return min(row)


def test_contamination_equals_full_alignment(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta", "lambda", "zeta", "iota", "mu"]
    make = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, make(rng.randrange(6, 25))) for i in range(12)] + [(50, None), (51, "tiny"), (52, ""), (53, "Abc, def"), (54, "mu"), (55, "mu"), (56, "C++"), (57, "?"), (58, " 1 ")]
    docs = [(100, "abc def"), (101, "xabc def tiny.\n TINY\t\n"), (102, "ABC,  def\nabc-def's"), (103, "tin y\nMU"), (104, "tiny " + make(60)),
            (105, "vitamin C is good\nc\nof 1 kind"), (106, "so\r\nc++\r\nis\n1"), (107, "what ?\n ?"), (1, None), (2, ""), (3, items[0][1].upper().replace(" ", ",\n ")), (4, make(300))]
    for i in range(5, 60):
        _, text = items[rng.randrange(12)]
        copy = list(text)
        for _ in range(rng.randrange(0, 10)):
            copy[rng.randrange(len(copy))] = rng.choice(["", "q", "zz"])
        docs.append((i, f"{make(20)}. {''.join(copy)} {make(20)}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(docs_of(spark, docs), bench, block_chars=400)
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in found.collect()}
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    want = {}
    for d, text in docs:
        for i, item in items:
            x, own = plain(item), [x.lower().split() for x in (item or "", *(text or "").split("\n"))]
            if len(x) < decontaminate.Q and own[0] and own[0] in own[1:]:
                want[d, i] = 0
            if len(x) >= decontaminate.Q and text:
                edits = _least_edits(x, plain(text))
                if edits <= decontaminate.budget(len(x))[0]:
                    want[d, i] = edits
    assert got == want and len(want) > 20
    clean = decontaminate.drop_contaminated(docs_of(spark, docs), bench)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.find_contamination(docs_of(spark, docs), bench.limit(0)).count() == 0
    assert decontaminate.find_contamination(docs_of(spark, []), bench.withColumn("doc_id", F.lit(1))).count() == 0
    far = decontaminate.find_contamination(docs_of(spark, [(1, "so it goes " * 50_000 + items[3][1])]), bench)
    assert (3, 550_000) in {(r["item_id"], r["start_char"]) for r in far.collect()}
    # the first of two equally close stretches, and each of repeated rows
    twice = decontaminate.find_contamination(docs_of(spark, [(1, "one\n tiny \ntiny"), (1, "one\n tiny \ntiny")]), bench).where("item_id = 51")
    assert table_of(twice, "doc_id", "start_char", "end_char", "distance") == [(1, 5, 9, 0), (1, 5, 9, 0)]


def _kneser_ney(texts, order):
    """A plain recursive model over the same cleaned characters."""
    edge = chr(quality_model.EDGE)
    clean = lambda t: "".join(map(chr, quality_model.clean(t)))
    counts = {order: Counter()}
    for t in map(clean, texts):
        padded = edge * (order - 1) + t + edge if t else ""
        counts[order].update(padded[i : i + order] for i in range(len(padded) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    off = {k: quality_model.discounts(*(sum(n == i for n in c.values()) for i in (1, 2, 3, 4))) for k, c in counts.items()}
    floor = 1 / (len(counts[1]) + 1)

    def p(gram):
        k = len(gram)
        if not k:
            return floor
        after = {g: n for g, n in counts[k].items() if g[:-1] == gram[:-1]}
        if not after:
            return p(gram[1:])
        cut = lambda n: off[k][min(n, 3) - 1]
        total = sum(after.values())
        own = (after[gram] - cut(after[gram])) / total if gram in after else 0
        return own + sum(map(cut, after.values())) / total * p(gram[1:])

    def nll(text):
        padded = edge * (order - 1) + clean(text) + edge if clean(text) else ""
        return -sum(math.log(p(padded[i : i + order])) for i in range(len(padded) - order + 1))

    return nll


def test_quality_model_equals_plain_kneser_ney(spark):
    rng = random.Random(6)
    good = ["".join(rng.choices(["ba ", "no", "ri", "ta ", "lu"], k=rng.randrange(8, 25))) for _ in range(25)]
    rows = [(i, t, "aa") for i, t in enumerate(good)] + [(100, "#$% x*x ## 99", "aa"), (101, None, "aa"), (102, " \n", "aa"), (103, "zzz zzz", "bb"), (104, "ba no", None), (105, good[0].upper(), "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("keep", F.lit("clash"))
    trusted = spark.createDataFrame([(i,) for i in range(25)], "doc_id long")
    model = quality_model.Model(quality_model.count_ngrams(df.where("doc_id < 25"), 3), 3)
    got = {r["doc_id"]: r["nll"] for r in quality_model.perplexities(df.select("doc_id", "lang", "text"), model).collect()}
    plain = _kneser_ney(good, 3)
    for i, t, _ in rows:
        assert got[i] == pytest.approx(plain(t), rel=1e-9, abs=1e-9), t
    judged = {r["doc_id"]: r for r in quality_model.judge_quality(df, trusted).collect()}
    assert len(judged) == len(rows) and sum(judged[i]["keep"] for i in range(25)) >= 20
    assert not judged[100]["keep"] and not judged[101]["keep"] and not judged[102]["keep"]
    # a language without trusted documents has the limit of all together
    assert not judged[103]["keep"] and judged[103]["limit"] == judged[104]["limit"] and judged[104]["lang"] == "und"
    assert quality_model.drop_low_quality(df, trusted).columns == df.columns
    assert quality_model.judge_quality(df.limit(0), trusted).count() == 0
    assert quality_model.judge_quality(df, trusted.limit(0)).where("keep").count() == len(rows) - 2


def test_repeated_words_are_one_character_each():
    mark = chr(quality_model.REPEAT)
    of = lambda t: "".join(map(chr, quality_model.clean(t)))
    assert of("And  and AND the\n9 8") == f"and{mark}{mark} the 0{mark}" and of("ab abc ab") == "ab abc ab" and of("x\x03x") == f"x{mark}"
    assert of(None) == of("") == of(" \n") == ""


def test_quality_limits_come_from_held_out_documents(spark):
    rng = random.Random(12)
    good = lambda: " ".join("".join(rng.choices(["ba", "no", "ri", "ta", "lu"], k=3)) for _ in range(rng.randrange(20, 60)))
    junk = lambda: " ".join([good().split()[0]] * rng.randrange(20, 60))
    rows = [(i, good(), "aa") for i in range(300)] + [(1000 + i, junk(), "aa") for i in range(20)] + [(2000, good() * 2000, "aa"), (2001, "#%" * 50_000, "aa")]
    rows += [(3000, rows[0][1], "aa")] * 200  # repeated rows
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    trusted = spark.createDataFrame([(i,) for i in range(200)], "doc_id long")
    judged = [(r["doc_id"], r["keep"]) for r in quality_model.judge_quality(df, trusted).collect()]
    assert len(judged) == len(rows)
    assert sum(keep for i, keep in judged if i < 300) >= 290
    assert not any(keep for i, keep in judged if 1000 <= i < 2000 or i == 2001)
    assert len({keep for i, keep in judged if i == 3000}) == 1 and (2000, True) in judged


def test_html_blocks():
    page = """<!DOCTYPE html><head><title>T</title><script>if (a<b) x="</p>";</script></head><body class="home-page"><header>Site</header>
    <nav><ul><li>Menu</ul></nav><div class="ad banner">Buy</div><main><article><header><h1>Head &amp; &lt;Tail&gt;</h1></header><p>One<b>two</b>
    three<br>four<p>Five&nbsp;six <a href='x>y'>link</a><!-- <p>no</p> --><form>f</form><aside>side</aside><section id="comments"><p>c</p></section>
    <style>p{}</style><p class=notice>n</p> tail</article></main><footer>foot</footer></body>"""
    assert html_extract.main_text(html_extract.lines_of(page), None) == "Head & <Tail> Onetwo three four Five six link tail"
    assert html_extract.lines_of(None) == [] and html_extract.lines_of("a < b & c") == [("a < b & c", False, False)]


def test_common_lines_are_the_least_of_the_longest_common_subsequences():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 12))] for _ in range(2))
        lo = 0
        while lo < min(len(a), len(b)) and a[lo] == b[lo]:
            lo += 1
        hi = 0
        while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
            hi += 1
        x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
        best = {0: [()]}  # lengths to places, of all subsequences that both have
        for places in itertools.chain.from_iterable(itertools.combinations(range(len(x)), k) for k in range(len(x) + 1)):
            rest = iter(y)
            if all(x[i] in rest for i in places):
                best.setdefault(len(places), []).append(places)
        want = {*range(lo), *(i + lo for i in min(best[max(best)])), *range(len(a) - hi, len(a))}
        assert html_extract.common_lines(a, b) == want


def test_many_equal_lines_take_no_square_of_time():
    a, b = (["x", "y"][k:] * 15_000 + ["end"] for k in (0, 1))
    assert len(html_extract.common_lines(a, b)) == 15_001


def test_shared_lines_go_outside_articles_only(spark):
    page = "<div>Site</div><nav>Menu {0}</nav><article><p>Own {0}</p><p>Often said</p></article><div>Note {0}</div><div>Imprint</div>".format
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(4)] + [(9, "http://a.example/9", "<p>" + "long " * 200_000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extract.extract_main_text(df).collect()}
    assert {i: got[i]["text"] for i in range(4)} == {i: f"Own {i} Often said Note {i}" for i in range(4)}
    assert got[0]["n_shared"] == 3 and got[0]["n_differencing"] == 2 and got[0]["n_markup"] == 1
    assert got[9]["n_chars"] == 5 * 200_000 - 1


def test_pages_lose_what_their_neighbour_has(spark):
    rows = [(i, f"http://site.example/{c}", f"<div>Site name</div><div>Own {c}</div><div>Imprint</div>") for i, c in enumerate("abc")]
    rows += [(10, None, None), (11, "http://alone.example/x", "<p>Only</p>"), (0, "http://site.example/a", "<div>Site name</div><div>Own a</div><div>Imprint</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).coalesce(1)
    got = table_of(html_extract.extract_main_text(df), "page_id", "text", "n_chars")
    assert got == [(0, "Own a", 5), (0, "Own a", 5), (1, "Own b", 5), (10, "", 0), (11, "Only", 4), (2, "Own c", 5)]
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


def test_partners_do_not_depend_on_partitions(spark):
    page = "<p>Shared</p><p>Own {}</p><p>Also shared</p>".format
    hot = [(i, f"http://h.x/b?q={i:03}", page(i)) for i in range(300)]
    cut = [(1000 + i, f"http://k.x/{i:03}", page(1000 + i)) for i in range(100)]
    alone = [(2000 + i, f"http://l.x/only?q={i}", page(i)) for i in range(3)]
    rows = [*hot, (900, "http://h.x/c", page(900)), *cut, *alone]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: (f"Own {i}", True) for i, *_ in rows if i < 2000}
    want |= {2000 + i: (f"Shared Own {i} Also shared", False) for i in range(3)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in (1, 4, 37):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found = html_extract.extract_main_text(df.repartition(n)).collect()
            assert {r["page_id"]: (r["text"], r["had_partner"]) for r in found} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_crc_of_ids_is_of_32_bits(spark):
    index = token_files.write_token_files(docs_of(spark, [(1, "hello there")]), WORDS, 2)
    row = token_files.read_token_files(index).first()
    assert row["ids_crc32"] == zlib.crc32(bytes(row["ids"])) and len(row["ids"]) == 4 * row["n_tokens"]
