"""Operators of the llm subpackage against brute force, on small tables that hold the odd cases."""

import collections
import hashlib
import json
import random
import re
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexgrain.llm import chat, components, deltas, exact_dedup, fingerprints, language, mixing, near_dedup, packed, packing, queries, sharding, substring_dedup, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def some_texts(n=60, seed=3):
    """Random texts with exact copies, near copies, shared passages, nulls, empty and long ones."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgoé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    make = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage = make(60)
    texts = []
    for i in range(n):
        t = "\n".join(make(r.randint(1, 50)) for _ in range(r.randint(1, 4)))
        if i % 5 == 1:
            t = texts[r.randrange(len(texts))] or ""
        elif i % 5 == 2:
            w = (texts[r.randrange(len(texts))] or "x y").split(" ")
            w[r.randrange(len(w))] = "edited"
            t = " ".join(w)
        elif i % 7 == 3:
            t = f"{make(9)} {passage} {make(9)}\n{t}"
        texts.append(t)
    return [*texts, None, "", "   ", "Word", "word", "a b c", make(3000), texts[0].upper(), "12 34", "<|endoftext|> x  y \n z"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 - 20, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "s1"][i % 4], len(t or "")) for i, t in enumerate(some_texts())]
    df = spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit(1), "size": F.lit("clash"), "salt": F.lit(2), "id": F.lit(3), "row": F.lit(4), "doc": F.lit("x"), "maybe": F.lit(True), "mark_word": F.lit(1), "score": F.lit(0.5), "copies": F.lit(7), "part": F.lit(0), "nth": F.lit(0)})
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=lambda x: x[0])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_empty_tables(spark, empty):
    model = language.fit([("en", "the cat"), ("fr", "le chat")])
    nodes = chat.as_nodes(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    for out in (
        exact_dedup.exact_dedup(empty), exact_dedup.drop_copies(empty), sharding.shard(empty), fingerprints.fingerprint_edits(empty), mixing.mix_sizes(empty), mixing.mix(empty), packing.pack(empty, queries.tokenizer_path()),
        language.predict(empty, model), near_dedup.near_dedup(empty), substring_dedup.substring_dedup(empty), suffix_dedup.suffix_dedup(empty), chat.format_paths(nodes),
    ):
        assert out.count() == 0
    assert language.accepted(empty).count() == 0


def test_exact_dedup(docs, rows):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(LOWER)].append(d)
    for keep, best in (("max", max), ("min", min)):
        got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs, keep).collect()}
        assert len(got) == len(rows)
        for t, ids in groups.items():
            for d in ids:
                r = got[d]
                assert (r["keep_id"], r["group_size"], r["kept"]) == (best(ids), len(ids), d == best(ids)) and r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(docs, keep).collect()) == sorted(map(best, groups.values()))


def test_exact_dedup_heavy_and_repeated(spark):
    df = spark.createDataFrame([(i, "Same" if i % 2 else f"t{i}") for i in range(400)] + [(1, "Same"), (None, "SAME"), (None, None)], "doc_id long, text string")
    got = exact_dedup.exact_dedup(df, "max").collect()
    same = [r for r in got if r["text_sha256"] == hashlib.sha256(b"same").hexdigest()]
    assert {(r["keep_id"], r["group_size"]) for r in same} == {(399, 202)} and sum(r["kept"] for r in same) == 1
    alone = [r for r in got if r["doc_id"] is None and r["group_size"] == 1]
    assert len(alone) == 1 and alone[0]["kept"]


def test_sharding(docs, rows, spark, tmp_path):
    got = sharding.shard(docs, shards=7, bucket_rows=9).collect()
    assert sorted(r["doc_id"] for r in got) == [d for d, _ in rows]
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert set(by) == set(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    text = dict(rows)
    for r in got:
        b = (text[r["doc_id"]] or "").encode()
        assert r["size"] == len(b) + 16 and r["text_crc32"] == zlib.crc32(b)
    key = lambda x: [(r["doc_id"], r["shard"], r["slot"]) for r in sorted(x, key=lambda r: r["doc_id"])]
    assert key(sharding.shard(docs, shards=7, bucket_rows=9).collect()) == key(got)
    assert key(sharding.shard(docs, shards=7, bucket_rows=9, seed=5).collect()) != key(got)
    sharding.write_shards(docs, str(tmp_path / "out"), shards=3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_fingerprints(docs, rows):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs).collect()}
    order = sorted(rows, key=lambda x: -x[0])
    by_text = collections.defaultdict(set)
    near, far = [], []
    for (d, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        t, after = t or "", after or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        by_text[t].add(got[d]["fingerprint"])
        by_text[edited].add(got[d]["edited_fingerprint"])
        if len(t.split()) > 30 and t != after:
            near.append(got[d]["near_edited"])
            far.append(got[d]["near_next"])
    assert all(len(x) == 1 for x in by_text.values()) and by_text[""] == {"0" * 32}
    assert np.mean(near) > np.mean(far) + 0.1


def simhash(text):
    """128 bits, from the definition: three-word terms vote with the bits of two 64-bit hashes."""
    import xxhash

    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    terms = [w[i : i + 3] for i in range(len(w) - 2)] if len(w) >= 3 else [w] if w else []
    votes = np.zeros(128, int)
    for t in terms:
        h = 42
        for x in t:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        h1 = xxhash.xxh64_intdigest((7).to_bytes(4, "little"), xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42))
        votes += [1 if (v >> b) & 1 else -1 for v in (h, h1) for b in range(64)]
    f = [sum(1 << b for b in range(64) if votes[64 * k + b] > 0) for k in (0, 1)]
    return f"{f[0]:016x}{f[1]:016x}"


def test_fingerprints_are_the_votes(spark, docs, rows):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs).collect()}
    order = sorted(rows, key=lambda x: -x[0])
    bits = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128
    for (d, t), (e, after) in zip(order, [*order[1:], order[0]], strict=True):
        t, after = t or "", after or ""
        m = len(t) // 3
        f, g = simhash(t), simhash(t[: len(t) - m] + after[:m])
        assert (got[d]["fingerprint"], got[d]["edited_fingerprint"]) == (f, g) and got[d]["near_edited"] == pytest.approx(bits(f, g)) and got[d]["near_next"] == pytest.approx(bits(f, simhash(after)))
    kinds = {int(r["fingerprint"], 16) for r in got.values()}
    for d, r in got.items():
        f = int(r["fingerprint"], 16)
        assert r["n_within"] == (sum(0 < bin(f ^ g).count("1") <= 3 for g in kinds) if d % 20 == 0 else None)
    same = [(5, "one two three four"), (5, "one two three four"), (5, "other words"), (None, None), (None, "x"), (None, "x")]
    out = fingerprints.fingerprint_edits(spark.createDataFrame(same, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["fingerprint"]) for r in out) == sorted((d or 0, simhash(t or "")) for d, t in same)


def test_fingerprints_count_neighbours(spark):
    r = random.Random(4)
    base = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    rows = []
    for i in range(60):  # long texts with a word or two edited differ in few bits
        w = list(base)
        for _ in range(i % 4):
            w[r.randrange(len(w))] = f"x{i}"
        rows.append((i * 5, " ".join(w)))
    got = fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kinds = {int(simhash(t), 16) for _, t in rows}
    want = {d: sum(0 < bin(int(simhash(t), 16) ^ g).count("1") <= 3 for g in kinds) for d, t in rows if d % 20 == 0}
    assert {x["doc_id"]: x["n_within"] for x in got if x["doc_id"] % 20 == 0} == want and sum(want.values()) > 0


def test_fingerprint_search(spark):
    r = random.Random(5)
    base = [(r.getrandbits(64) - 2**63, r.getrandbits(64) - 2**63) for _ in range(40)]
    flip = lambda f, k: (f[0] ^ sum(1 << b for b in r.sample(range(62), k)), f[1])
    all_ = base + [flip(f, k) for k, f in zip([1, 2, 3, 4, 5] * 8, base, strict=True)]
    df = spark.createDataFrame(all_, "f0 long, f1 long")
    got = {((x["f0"], x["f1"]), (x["g0"], x["g1"])) for x in fingerprints.within_radius(df, df, 3).collect()}
    dist = lambda a, b: sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b, strict=True))
    assert got == {(a, b) for a in all_ for b in all_ if dist(a, b) <= 3}


def test_mixing(docs, rows):
    got = mixing.mix_sizes(docs).collect()
    size = {d: len(WORD.findall(t or "")) for d, t in rows}
    assert {r["doc_id"]: r["size"] for r in got} == size
    per = collections.defaultdict(list)
    for r in got:
        per[r["source"]].append(r)
        assert r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"]
    total = 1.5 * sum(size.values())
    assert sum(x[0]["target"] for x in per.values()) == pytest.approx(total)
    for x in per.values():
        assert x[0]["source_size"] == sum(r["size"] for r in x) and x[0]["target"] <= 2 * x[0]["source_size"] + 1e-9
        assert abs(sum(r["taken"] for r in x) - x[0]["target"]) <= max(r["size"] for r in x)
    assert sorted(map(tuple, mixing.mix_sizes(docs).collect())) == sorted(map(tuple, got)) if not any(None in r for r in map(tuple, got)) else True
    taken = collections.Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert taken == {r["doc_id"]: r["copies"] for r in got if r["copies"]}


def test_mixing_follows_worth(docs):
    df = docs.withColumn("worth", F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(0.5))
    got = mixing.mix_sizes(df, share_percent=60, worth="worth").where("size > 0").collect()
    mean = lambda k: np.mean([r["copies"] for r in got if (r["doc_id"] % 2 == 0) == k])
    assert mean(True) > mean(False)


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows}
    got = packing.pack(docs, queries.tokenizer_path(), window=256).collect()
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] > 0 and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, x in pieces.items():
        assert [a for a, _ in sorted(x)] == np.cumsum([0, *[n for _, n in sorted(x)]]).tolist()[:-1] and sum(n for _, n in x) == len(ids[d])
    assert set(pieces) == set(ids)
    padding = 0
    for x in windows.values():
        x.sort()
        assert [a for a, _ in x] == np.cumsum([0, *[n for _, n in x]]).tolist()[:-1]
        fill = sum(n for _, n in x)
        assert fill <= 256
        padding += 0 if fill & (fill - 1) == 0 else 256 - fill
    assert padding == 0


def test_sum_of_squares_levels():
    p = packing.Packer(10)
    for n in (6, 6, 4):
        p.add(1, np.arange(n, dtype="<u4"))
    assert p.levels[6] == 1 and [x[2] for x in p.out] == [6, 4]  # the piece of four fills a window of six


def test_chunks_tokenise_as_whole_texts():
    tok = packing.ChunkTokenizer(queries.tokenizer_path())
    texts = [*[t for t in some_texts(20) if t is not None], "it's we'll 'S x", "中文 mixed  nbsp", "a b  c", " lead", "tail ", "tab\tand\nline", "é'll 1.5% ١", "<|endoftext|>", "naïve café œuvre \U0001f600 ok"]
    ids, counts = tok(pa.array(texts))
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == tok.tok.encode(t, add_special_tokens=False).ids, t
        at += n


def test_language(spark):
    en, fr, ru = "the quick brown fox jumps over the lazy dog and then the cat", "le chat est sur la table et il mange une pomme avec des amis", "быстрая лиса прыгает через ленивую собаку и кошку"
    rows = [(i, x, k, None, 0) for i, (x, k) in enumerate([(en, "en"), (fr, "fr"), (ru, "ru")] * 30)]
    odd = [(1000, None, None, None, 0), (1001, "", None, None, 0), (1002, "123 !!", None, None, 0), (1003, en + " " + fr, None, None, 0), (1004, "лиса", None, None, 0), (1005, "你好", None, None, 0)]
    df = spark.createDataFrame(rows + odd, DOCS)
    model = language.train(df)
    got = {r["doc_id"]: r for r in language.predict(df.withColumn("extra", F.array(F.lit(1))), model, spans=True).collect()}
    assert all(got[i]["lang_pred"] == k and got[i]["score"] > 0.9 for i, _, k, _, _ in rows)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1002]["score"] == 0
    assert [s["lang"] for s in got[1003]["lang_spans"]] == ["en", "fr"] and sum(s["words"] for s in got[1003]["lang_spans"]) == len((en + " " + fr).split())
    assert got[1004]["lang_pred"] == "ru" and got[1005]["lang_pred"] in ("en", "fr", "ru") and got[1005]["score"] == 0
    kept = {r["doc_id"] for r in language.accepted(df).collect()}
    assert kept >= {r[0] for r in rows} and not kept & {1000, 1001, 1002}


def test_language_of_quoted_and_unspaced_words(spark):
    fr, en = "le chat est sur la table et il mange une pomme avec des amis", "the quick brown fox jumps over the lazy dog and then the cat"
    ja, zh = "これはペンです。私は学生です。あなたは先生ですか", "我是学生。他们在学校学习中文,你好吗"
    rows = [(i, x, k) for i, (x, k) in enumerate([(fr, "fr"), (en, "en"), (ja, "ja"), (zh, "zh")] * 20)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = [(0, " ".join(f"\u201c{w}\u201d" for w in fr.split()), "fr"), (1, "\U0001f600 " + fr, "fr"), (2, ja[3:15], "ja"), (3, zh[2:12], "zh"), (4, "\u00abla pomme des amis\u00bb", "fr")]
    df = spark.createDataFrame([(i, t, 7.0, "x") for i, t, _ in odd], "doc_id long, text string, score double, lang_pred string")  # columns that predict adds
    got = {r["doc_id"]: r for r in language.predict(df, model, spans=True).collect()}
    assert {i: got[i]["lang_pred"] for i, *_ in odd} == {i: k for i, _, k in odd} and all(got[i]["score"] > 0.9 for i, *_ in odd)
    assert got[2]["lang_spans"][0]["words"] > 5
    kept = language.accepted(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("z")))
    assert kept.count() == len(rows) and kept.columns == ["doc_id", "text", "lang", "score", "lang_pred"]
    none = spark.createDataFrame([(1, "some text", None), (2, "1", None)], "doc_id long, text string, lang string")
    assert language.accepted(none).count() == 2 and {r["lang_pred"] for r in language.predict(none, language.train(none)).collect()} == {"und"}


def test_language_learns_from_long_texts(spark):
    r = random.Random(4)
    words = {"aa": ["kato", "mira", "selo", "tanu"], "bb": ["wrych", "gwyth", "llyn", "pwll"]}
    text = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n))
    rows = [(i, text("aa", 30_000), "aa") for i in range(3)] + [(10 + i, text("bb", 20), "bb") for i in range(9)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = language.predict(spark.createDataFrame([(1, text("aa", 9)), (2, text("bb", 9))], "doc_id long, text string"), model).collect()
    assert [x["lang_pred"] for x in sorted(got, key=lambda x: x["doc_id"])] == ["aa", "bb"]


def test_language_held_out_accuracy(spark):
    from pathlib import Path

    sf = "/root/testdata/sf0.01"
    if not Path(sf).exists():
        pytest.skip("no test tables")
    out = queries.op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("true")), "doc_id")
    held = out.where("held_out and true is not null and lang_pred <> 'und'").agg(F.avg((F.col("true") == F.col("lang_pred")).cast("double")).alias("a"), F.count(F.lit(1)).alias("n")).first()
    assert held["n"] > 200 and held["a"] > 0.9


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(1)
    scores, first = r.normal(0, 3, (9, 3)).astype(np.float32), np.array([0, 4, 4, 9])
    which = np.arange(9)
    got = language.viterbi(scores, which, first, 2.0)
    import itertools

    for a, b in ((0, 4), (4, 9)):
        value = lambda p, a=a: sum(scores[a + i, k] for i, k in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:], strict=False))
        best = max(itertools.product(range(3), repeat=b - a), key=value)
        assert value(got[a:b]) == pytest.approx(value(best), abs=1e-4)


def shingle_sets(rows, n):
    out = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out[d] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    return out


def brute_components(sets, percent=80):
    part = {d: d for d in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                part[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("short", [48, 2])
def test_near_dedup(docs, rows, monkeypatch, short):
    monkeypatch.setattr(near_dedup, "SHORT", short)  # 2: all longer lists get pivots
    sets = shingle_sets(rows, 4)
    want = brute_components(sets)
    got = near_dedup.near_dedup(docs, 4, 0.8).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {d: (len(s), want[d], want[d] == d) for d, s in sets.items()}


@pytest.mark.parametrize("crowded,wide,held", [(1200, 4096, 1 << 25), (3, 4096, 1 << 25), (0, 3, 1 << 13), (3, 99, 0)])
def test_near_dedup_families(spark, monkeypatch, crowded, wide, held):
    """Families of edited copies, most of them about as like as the limit asks for, and texts that share a passage."""
    r = random.Random(11)
    monkeypatch.setattr(near_dedup, "SHORT", 3)
    monkeypatch.setattr(deltas, "CROWDED", crowded)
    monkeypatch.setattr(deltas, "WIDE", wide)
    monkeypatch.setattr(deltas, "SETS_BYTES", held)  # 0: no list is compared in memory
    if crowded < 1000:
        monkeypatch.setattr(deltas, "HELD", 50)
        monkeypatch.setattr(deltas, "RANKED", 20)
    vocab = [f"v{i}" for i in range(300)]
    texts, passage = [], [r.choice(vocab) for _ in range(40)]
    for size, copies in ((60, 60), (35, 30)):
        base = [r.choice(vocab) for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, 6)):
                k = r.randrange(len(w))
                r.choice([lambda: w.__setitem__(k, r.choice(vocab[:6])), lambda: w.pop(k), lambda: w.insert(k, r.choice(vocab[:6]))])()
            texts.append(" ".join(w))
            if r.random() < 0.2:  # families within the family
                base = w
    texts += [" ".join([*passage, *(r.choice(vocab) for _ in range(r.randint(0, 30)))]) for _ in range(25)]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    want = brute_components(shingle_sets(rows, 4))
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 4, 0.8).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == want


def test_near_dedup_shared_and_null_identifiers(spark):
    r = random.Random(2)
    b, c, lone = (" ".join(f"{k}{r.randrange(10**6)}" for _ in range(60)) for k in "bcx")
    rows = [(1, b), (2, b + " x"), (2, c), (3, c + " y"), (None, b), (None, lone), (7, lone), (2, b + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x["doc_id"] or 0, x["component_id"] or 0, x["kept"]) for x in near_dedup.near_dedup(df, 4).collect()))
    assert got == [(0, 0, True), (0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False), (2, 1, False), (3, 1, False), (7, 7, True)]
    assert sorted((x["doc_id"] or 0) for x in near_dedup.drop_near(df, 4).collect()) == [0, 0, 1, 7]


def test_near_dedup_keeps_columns(docs):
    out = near_dedup.drop_near(docs)
    assert out.columns == docs.columns and out.count() < docs.count()


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (5, 5), (None, 3)] + [(500, 500 + k) for k in range(1, 60)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200, **{500 + k: 500 for k in range(60)}}


@pytest.mark.parametrize("heavy", [24, 0])
def test_suffix_dedup(docs, rows, monkeypatch, heavy):
    if not heavy:  # every sampled gram that occurs twice is dealt window by window
        monkeypatch.setattr(suffix_dedup, "HEAVY", 0)
        cut = suffix_dedup.splitters
        monkeypatch.setattr(suffix_dedup, "splitters", lambda *a: (cut(*a)[0], set(cut(*a)[0].tolist())))
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(docs, texts=True).collect()}
    seen = set()
    assert len(got) == len(rows)
    for d, t in rows:
        b = (t or "").encode()
        mark = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                mark[i : i + 100] = True
            seen.add(b[i : i + 100])
        left = bytes(np.frombuffer(b, np.uint8)[~mark])
        spans = int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum())
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (len(b), int(mark.sum()), spans, left) and r["kept_sha256"] == hashlib.sha256(left).hexdigest()


def test_suffix_dedup_shared_and_null_identifiers(spark):
    r = random.Random(9)
    a, b, c, d = ("".join(r.choice("abcdefgh ") for _ in range(240)) for _ in range(4))
    rows = [(1, a), (7, a + b), (7, c), (None, d), (None, d + b), (None, None), (3, c), (3, c), (9, d)]
    got = collections.Counter((x["doc_id"], bytes(x["kept"]).decode()) for x in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), texts=True).collect())
    assert sum(got.values()) == len(rows) and got[(1, a)] == 1 and got[(3, c)] == 2 and got[(9, "")] == 1
    nulls = [t for (k, t) in got.elements() if k is None]
    assert sorted(map(len, nulls)) in ([0, 240, 240], [0, 0, 480]) and any(t.endswith(b) for t in nulls)
    assert got[(7, "")] == 2  # a, b and c all stand in rows before


def test_suffix_dedup_long_pieces(spark, monkeypatch):
    r = random.Random(1)
    body = "".join(r.choice("ab cd") for _ in range(3000))
    c = list(suffix_dedup.chunks(pa.array(["x" * 50, body, None])))
    assert sum(len(x.rows) for x in c) == 3
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", 100)
    whole = suffix_dedup.Chunk(np.frombuffer(body.encode(), np.uint8), np.array([0]), np.array([3000]), np.array([0]))
    one = {(a, f, t) for a, f, t in zip(*[x.tolist() for x in whole.runs(whole.hashes()[0])[:3]], strict=True)}
    parts = set()
    for x in suffix_dedup.chunks(pa.array([body])):
        parts |= {(a + x.base, p + x.base) for a, f, t in zip(*[y.tolist() for y in x.runs(x.hashes()[0])[:3]], strict=True) for p in range(f, t + 1)}
    assert parts == {(a, p) for a, f, t in one for p in range(f, t + 1)}


def test_suffix_dedup_short_chunks(spark):
    for n in range(141):
        c = suffix_dedup.Chunk(np.arange(n, dtype=np.uint8), np.array([0]), np.array([n]), np.array([0]))
        for which in (0, 1):
            grams, whole = c.hashes(which)
            assert (len(grams), len(whole)) == (max(n - suffix_dedup.GRAM + 1, 0), max(n - suffix_dedup.WINDOW + 1, 0))
        _, first, last, _ = c.runs(c.hashes()[0])
        assert int((last - first + 1).sum()) == len(whole)
    for n in (6, 50):
        got = suffix_dedup.suffix_dedup(spark.createDataFrame([(1, "x" * n)], "doc_id long, text string")).collect()
        assert [(r["n_bytes"], r["n_removed"]) for r in got] == [(n, 0)]


def sent_suffixes(rows, buckets=1):
    """Packed suffixes (bucket, blob) that one task sends of rows (identifier, text), all of whose grams repeat."""
    texts = pa.array([t for _, t in rows])
    known = np.concatenate([c.hashes()[0] for c in suffix_dedup.chunks(texts)])
    ids = pa.array([i for i, _ in rows], pa.int64())
    task = pa.RecordBatch.from_arrays([ids, texts, ids, pa.array([known.tobytes()] * len(rows), pa.binary())], names=["doc", "text", "row", "blob"])
    docs = types.SimpleNamespace(
        sparkSession=types.SimpleNamespace(sparkContext=types.SimpleNamespace(broadcast=lambda x: types.SimpleNamespace(value=x))),
        mapInArrow=lambda work, schema: [(k, y) for b in work(iter([task])) for k, y in zip(b["bucket"].to_pylist(), b["blob"].to_pylist(), strict=True)],
    )
    cuts = np.array(sorted(suffix_dedup._grams_at(np.frombuffer(texts[0].as_py().encode(), np.uint8), np.arange(0, 700, 100))), "S32")[: buckets - 1]
    return suffix_dedup.suffixes(docs, cuts, set(), buckets)


def test_suffix_dedup_sorts_equal_suffixes_once(monkeypatch):
    """Copies that tasks have sent are compared whole: their windows don't enter the sort, and all but the first go."""
    r = random.Random(4)
    text = "".join(r.choice("abcdefgh ") for _ in range(900))
    sorted_ = []
    sort = suffix_dedup.multikey_sort
    monkeypatch.setattr(suffix_dedup, "multikey_sort", lambda data, at, lead: sorted_.append(len(at)) or sort(data, at, lead))
    other = text[:450] + "#" + text[451:]  # its suffixes around the edit share grams with the others'
    parts = [packed.unpack(y) for i, t in [*((i, text) for i in range(20)), (20, other)] for _, y in sent_suffixes([(i, t)])]
    gone = collections.defaultdict(lambda: np.zeros(900, bool))
    for b in suffix_dedup._sort_bucket(iter(parts), 1):
        for y in b["blob"].to_pylist():
            x = packed.unpack(y)
            for row, s, e in zip(x["row"], x["a"], x["b"], strict=True):
                gone[int(row)][s:e] = True
    assert set(gone) == set(range(1, 21)) and all(gone[i].all() for i in range(1, 20))
    assert np.flatnonzero(~gone[20]).tolist() == [450]
    assert sum(sorted_) < 2 * 900  # of 21 texts with 801 windows


def test_suffix_dedup_packs_many_chunks_at_once(monkeypatch):
    """A task's packed rows don't grow with its chunks times the buckets."""
    r = random.Random(5)
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", 4096)
    rows = [(i, "".join(r.choice("abcdefgh ") for _ in range(1000))) for i in range(80)]
    sent = sent_suffixes(rows, 8)
    assert len(sent) == len({k for k, _ in sent}) == 8


def brute_substrings(rows, passage, line, n=5):
    """Words that go of each row (identifier, text), by comparing all lines and all stretches; rows in order."""
    words, lines = [], []
    for t, (_, text) in enumerate(rows):
        at = 0
        words.append(WORD.findall((text or "").translate(LOWER)))
        for x in (text or "").split("\n"):
            k = len(WORD.findall(x))
            if k >= line:
                lines.append((t, at, at + k, tuple(words[t][at : at + k])))
            at += k
    gone = [set() for _ in rows]
    sets = {w: frozenset(w[i : i + n] for i in range(len(w) - n + 1)) for *_, w in lines}
    kinds = sorted(sets, key=lambda w: min(i for i, x in enumerate(lines) if x[3] == w))
    part = brute_components({i: sets[w] for i, w in enumerate(kinds)})
    seen = set()
    for t, a, b, w in lines:
        c = part[kinds.index(w)]
        if c in seen:
            gone[t] |= set(range(a, b))
        seen.add(c)
    before = set()
    for t, w in enumerate(words):
        for i in range(len(w) - passage + 1):
            if tuple(w[i : i + passage]) in before:
                gone[t] |= set(range(i, i + passage))
            before.add(tuple(w[i : i + passage]))
    return words, gone


def check_substrings(rows, got, passage=32, line=16):
    words, gone = brute_substrings(rows, passage, line)
    assert len(got) == len(rows)
    for t, (d, _) in enumerate(rows):
        assert got[d]["n_words"] == len(words[t]) and got[d]["n_removed_words"] == len(gone[t])
        assert WORD.findall(got[d]["text"].translate(LOWER)) == [w for i, w in enumerate(words[t]) if i not in gone[t]]


@pytest.mark.parametrize("short,line", [(48, 16), (2, 8)])
def test_substring_dedup(docs, rows, monkeypatch, short, line):
    monkeypatch.setattr(near_dedup, "SHORT", short)
    check_substrings(rows, {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs, line=line).collect()}, line=line)


def test_substring_dedup_whole_passages(spark, tmp_path):
    r = random.Random(5)
    fresh = (f"w{i}" for i in range(1 << 30))
    new = lambda k: [next(fresh) for _ in range(k)]
    shared = [new(k) for k in (32, 33, 50, 90, 200)]
    texts = {None: new(30) + shared[0] + new(4), -3: [], 5: new(120)}
    for d in range(10, 50):
        w = new(r.randint(60, 90))
        for _ in range(r.randint(1, 3)):
            w += r.choice(shared) + new(r.randint(10, 90))
        texts[d] = w
    ends = {r.choice(p) for p in shared}  # a passage has a line's end in some documents
    sep = lambda d, x: "\n" if d % 3 == 0 and x in ends else r.choice([" ", "  "])
    rows = [(d, "".join((x.upper() if d == 12 else x) + sep(d or 0, x) for x in w)) for d, w in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x for x in queries.op3_substring_dedup(spark, str(tmp_path)).collect()}
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0))
    check_substrings(rows, got)


def test_substring_dedup_edited_lines(spark):
    """Near copies of lines around the limit, in families, with large and negative identifiers."""
    r = random.Random(8)
    vocab = [f"v{i}" for i in range(200)]
    base = [[r.choice(vocab) for _ in range(k)] for k in (20, 40, 80)]
    rows = []
    for i in range(60):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((r.choice([-1, 1]) * (2**62 - i * 977), " ".join(r.choice(vocab) for _ in range(5)) + "\n" + " ".join(w)))
    rows.sort()
    check_substrings(rows, {x["doc_id"]: x for x in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), passage=100).collect()}, passage=100)


def test_substring_dedup_odd_rows(spark):
    for t in (None, "", "  ", "\n \n", "one"):  # alone in its slice
        df = spark.createDataFrame([(1, t)], "doc_id long, text string")
        assert [(x["n_removed_words"], x["text"]) for x in substring_dedup.substring_dedup(df).collect()] == [(0, t or "")]
    many = "\n" * (1 << 20) + " ".join(f"m{i}" for i in range(40))
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(1, a), (7, a + "\n" + b), (7, c), (None, c + "\n" + many), (None, b), (None, "lone " + many), (3, a), (3, a)]
    got = collections.Counter((x["doc_id"], x["text"].strip().strip("\n")) for x in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    left = " ".join(f"m{i}" for i in range(40))
    assert got[(1, a)] == 1 and got[(3, "")] == 2 and got[(7, "")] == 2  # b and c stand in rows without identifier, which come first
    nulls = sorted(t for (d, t) in got.elements() if d is None)
    assert b in nulls and sum(left in t for t in nulls) == 1 and any(t.startswith(c) for t in nulls) and any(t.startswith("lone") for t in nulls)


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi \\ <|im_start|> <s> <<SYS>>"), (1, 1, "assistant", said), (1, 2, "user", None), (1, 3, "assistant", "a\\|b\n<|im_end|>\n<\\|im_end|>"), (2, 0, "sys\ntem\\", ""), (3, 1, "assistant", "x"), (3, 1, "assistant", "x"), (None, 0, "user", "lone"), (4, None, None, "no role")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("score", F.lit(1))
    got = {r["tree"]: r for r in chat.read_back(chat.format_paths(chat.as_nodes(df))).collect()}
    for tree in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == tree), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t["role"], t["text"]) for t in got[tree]["turns"]] == [(r[2] or "", r[3] or "") for r in mine]
        assert got[tree]["loss_text"] == "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert not any(m in got[tree]["formatted"].replace(chat.START, "").replace(chat.END, "") for m in chat.CONTROLS)


def test_long_and_wide_trees(spark):
    r = random.Random(6)
    parent = {0: None} | {i: i - 1 for i in range(1, 700)}  # a chain
    parent |= {i: r.choice([0, 5, 600]) for i in range(700, 800)} | {i: r.randrange(700, i) for i in range(801, 900)} | {800: None}
    df = spark.createDataFrame([(str(k), None if p is None else str(p)) for k, p in parent.items()], "node string, parent string")
    got = collections.defaultdict(dict)
    for x in chat.steps(df).collect():
        got[int(x["leaf"])][x["above"]] = int(x["node"])
    leaves = set(parent) - set(parent.values())
    assert set(got) == leaves
    for leaf in leaves:
        path, at = [], leaf
        while at is not None:
            path.append(at)
            at = parent[at]
        assert [got[leaf][i] for i in range(len(path))] == path and len(got[leaf]) == len(path)


def test_reply_trees(spark):
    nodes = [("t", "a", None, "user", "q", 0.0), ("t", "b", "a", "assistant", "good", 2.0), ("t", "c", "a", "assistant", "bad", 1.0), ("t", "d", "b", "user", "more", 0.5), ("t", "e", "missing", "user", "orphan", 9.0)]
    df = spark.createDataFrame(nodes, "tree string, node string, parent string, role string, text string, score double")
    got = {r["leaf"]: (r["rank"], r["score"]) for r in chat.format_paths(df).collect()}
    assert got == {"e": (1, 9.0), "d": (2, 2.5), "c": (3, 1.0)}
    assert {r["leaf"] for r in chat.format_paths(df, best=1).collect()} == {"e"}
    loop = spark.createDataFrame([("t", "a", "b", "u", "", 0.0), ("t", "b", "a", "u", "", 0.0)], df.schema)
    with pytest.raises(ValueError, match="cycle"):
        chat.format_paths(loop).count()


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    (tmp_path / "sf").mkdir()
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    df, seen = spark.read.parquet(str(tmp_path / "sf" / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path / "sf"))
        df.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        seen.append((name, df.columns, df.select("doc_id").collect()))
    assert all(c == ["doc_id", "text", "lang", "source", "n_chars"] for _, c, _ in seen[:-1])
    ids = [sorted(r[0] for r in x) for _, _, x in seen]
    assert set(ids[0]) >= set(ids[1]) >= set(ids[2]) >= set(ids[3]) == set(ids[4])
    texts = dict((r[0], r[1]) for r in docs.select("doc_id", "text").collect())
    lower = collections.defaultdict(list)
    for d in ids[0]:
        lower[texts[d].translate(LOWER)].append(d)
    assert ids[1] == sorted(min(x) for x in lower.values())
    want = brute_components(shingle_sets([(d, texts[d]) for d in ids[1]], 5))
    assert ids[2] == sorted(d for d in ids[1] if want[d] == d)
    assert json.dumps(ids[3]) and corpus_pipeline.run(spark, str(tmp_path / "sf")).count() > 0
