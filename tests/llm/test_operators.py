"""The ten operators and the pipeline on small tables, against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import embedding_dedup, exact_dedup, filters, license_scan, mixing, near_dedup, packing, queries, suffix_dedup, token_output, toxicity, warc
from lodestone.llm.common import arrow_rows, fresh_path, read_table
from lodestone.llm.tokenize import default_path

DOCS = "doc_id long, text string, source string, kept string, bin int"  # some names clash with the operators' own


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_words(text):
    return re.findall("[0-9a-z\u0080-\U0010ffff]+", lower(text))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, repeated rows, a very long text, clashing column names."""
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))
    passage, base = prose(60), prose(200)
    near = base.split()
    near[100] = "changed"
    rows = [
        (1, None, "a"), (2, "", None), (3, "Hello World", "a"), (4, "hello world", "b"), (5, base, "a"), (6, " ".join(near), "a"), (7, prose(80) + " " + passage + " " + prose(30), "b"), (8, prose(20) + "\n" + passage.upper(), "b"),
        (9, prose(30_000), "c"), (10, "É", "a"), (11, "é", "a"), (3, "Hello World", "a"), (None, "hello WORLD", "a"), (None, prose(12), None), (12, "Released under the MIT License. MIT\nlicense", "a"), (13, "x" * 50_000, "c"), (14, "CC-BY (NC) apache license, version 2.0", "c"),
    ]
    return spark.createDataFrame([(i, t, s, "k", 1) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(odd, none):
    for keep, best in (("max", max), ("min", min)):
        groups = defaultdict(list)
        for r in odd.collect():
            groups[lower(r["text"])].append(r["doc_id"])
        want = Counter()
        for text, ids in groups.items():
            first = best((i for i in ids if i is not None), default=None)
            digest = hashlib.sha256(text.encode()).hexdigest()
            done = False
            for i in ids:
                kept = i == first and not done
                done |= kept
                want[(i, first, len(ids), kept, digest)] += 1
        got = Counter(tuple(r) for r in exact_dedup.exact_dedup(odd, keep).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
        assert got == want
        kept = exact_dedup.keep_distinct(odd, keep)
        assert kept.columns == odd.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.keep_distinct(none).count() == 0


def test_exact_dedup_verifies_bytes(odd, monkeypatch):
    """With a digest that collides, bytes decide."""
    monkeypatch.setattr(exact_dedup, "digest", lambda c: F.lit("00" * 32))
    monkeypatch.setattr(exact_dedup, "short_hash", lambda c: F.lit(5).cast("long"))
    got = {tuple(r) for r in exact_dedup.exact_dedup(odd.where("doc_id in (4, 5, 6, 8) or doc_id = 3"), "max").select("doc_id", "keep_id", "group_size").collect()}
    assert got == {(4, 4, 3), (3, 4, 3), (5, 5, 1), (6, 6, 1), (8, 8, 1)}


def test_exact_dedup_salts(odd, monkeypatch):
    want = sorted(map(repr, exact_dedup.exact_dedup(odd.unionByName(odd)).collect()))
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 1)
    assert sorted(map(repr, exact_dedup.exact_dedup(odd.unionByName(odd)).collect())) == want


@pytest.mark.parametrize("most", [filters.BROADCAST_BITMAPS, 0])
def test_merge_index_takes_later_batches(spark, odd, none, monkeypatch, most):
    """Batches against an index of several levels; filters broadcast and joined; bytes decide where hashes collide."""
    monkeypatch.setattr(filters, "BROADCAST_BITMAPS", max(most, 1))
    if not most:
        monkeypatch.setattr(filters, "BITMAP_BITS", 64)  # many small bitmaps
        monkeypatch.setattr(exact_dedup, "short_hash", lambda c: F.pmod(F.xxhash64(c), F.lit(7)))
    rng = random.Random(2)
    rows = [(i, f"Text {rng.randint(0, 60)}") for i in range(90)]
    make = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    index, seen = exact_dedup.MergeIndex(spark), {}
    assert index.lookup(make(rows), none).count() == 0
    for k in range(0, 90, 15):
        batch = rows[k : k + 15]
        got = Counter(tuple(r) for r in index.lookup(make(batch), make(rows[:k] or [(None, "-")])).collect())
        assert got == Counter((i, seen[lower(t)]) for i, t in batch if lower(t) in seen)
        index.add(make(batch))
        for i, t in batch:
            seen.setdefault(lower(t), i)
    assert sorted(r["level"] for r in index.runs) == [1, 1, 2]
    assert {r["keep_id"]: r["n_rows"] for r in index.merged().collect()} == {first: sum(lower(t) == text for _, t in rows) for text, first in seen.items()}
    index.add(none.select("doc_id", "text"))
    assert index.merged().count() == len(seen)


def test_mixing(spark, odd, none, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    out = mixing.mix(docs, out_chars=None)
    again = mixing.mix(docs)
    assert sorted(map(tuple, out.select("doc_id", "mixed.copy").collect())) == sorted(map(tuple, again.select("doc_id", "mixed.copy").collect()))
    rates = {r["source"]: r for r in mixing.rates(docs).collect()}
    chars = sum(r["chars"] for r in rates.values())
    assert abs(sum(r["rate"] * r["chars"] for r in rates.values()) - chars) < 1e-3
    for rate in (0.003, 2.5, 40.0, 3000.0, 1e7):
        (row,) = mixing.distributions(spark.createDataFrame([("s", rate), ("t", 0.0)], "source string, rate double")).collect()
        c, least = row["cumulative"], row["least"]
        assert len(c) < 26 * math.sqrt(rate) + 60 and abs(c[-1] - 1) < 1e-7 and sorted(c) == c
        p = [math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(least, least + len(c))]
        assert all(abs(x - y) < (1e-12 if rate < 100 else 1e-7) for x, y in zip(c, itertools.accumulate(p)))
    many = mixing.mix(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"), F.lit("s").alias("source")), {"s": 1.0}, out_chars=24_000)
    n = many.count()
    assert abs(n - 12_000) < 5 * math.sqrt(12_000)
    only = mixing.mix(odd, {"a": 1.0})
    assert {r["source"] for r in only.collect()} == {"a"} and only.columns[:5] == odd.columns
    assert mixing.mix(none).count() == 0 and mixing.mix(odd, {}).count() == 0
    keys = [r["mixed"]["shuffle_key"] for r in out.coalesce(1).collect()]
    assert len(set(keys)) == len(keys)


def brute_mix(rows, weights=None, chars=None):
    """(doc_id, text, copy, copies, shuffle_key) of all copies, a source's rate and a document's number of copies from their definitions."""
    size, out = Counter(), Counter()
    for r in rows:
        size[r["source"]] += len(r["text"] or "")
    weigh = {s: (math.sqrt(n) if weights is None else weights.get(s or "", 0.0)) if n else 0.0 for s, n in size.items()}
    chars = sum(size.values()) if chars is None else chars
    for r in rows:
        rate = weigh[r["source"]] / sum(weigh.values()) * chars / size[r["source"]] if size[r["source"]] else 0.0
        u = (int(hashlib.md5(f"mix-1-count|{r['doc_id']}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        k, p, total = 0, math.exp(-rate), math.exp(-rate)
        while rate and u >= total:
            k += 1
            p *= rate / k
            total += p
        for copy in range(1, k + 1):
            out[(r["doc_id"], r["text"], copy, k, hashlib.md5(f"mix-1-order|{r['doc_id']}|{copy}".encode()).hexdigest()[:16])] += 1
    return out


def test_mixing_by_brute_force(spark, odd, monkeypatch):
    """Copies are the inverse of the distribution at the hashed number; also with the table joined by shuffle and copies listed in stretches."""
    docs = odd.where("doc_id is not null")
    weights, chars = {"a": 1.0, "b": 3.0, "": 2.0}, 400_000
    want = brute_mix(docs.collect(), weights, chars)
    assert sum(want.values()) > 100 and max(x[3] for x in want) > 3
    for numbers, stretch in ((mixing.BROADCAST_NUMBERS, mixing.STRETCH), (0, 2)):
        monkeypatch.setattr(mixing, "BROADCAST_NUMBERS", numbers)
        monkeypatch.setattr(mixing, "STRETCH", stretch)
        got = mixing.mix(docs, weights, chars)
        assert Counter(map(tuple, got.select("doc_id", "text", "mixed.copy", "mixed.copies", "mixed.shuffle_key").collect())) == want
    tiny = spark.createDataFrame([(1, "x", "s"), (2, "y" * 2000, "t")], "doc_id long, text string, source string")
    assert abs(mixing.mix(tiny, {"s": 1.0, "t": 0.0}, 300_000).count() - 300_000) < 5000


def test_license_scan(odd, none, spark):
    phrases = {tuple(k.split()): v for k, v in license_scan.PHRASES.items()}
    got = Counter(tuple(r) for r in license_scan.scan(odd).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect())
    want = Counter()
    for r in odd.collect():
        w = plain_words(r["text"])
        at = [(i, v) for p, v in phrases.items() for i in range(len(w) - len(p) + 1) if tuple(w[i : i + len(p)]) == p]
        starts = [i for i, _ in at]
        want[(r["doc_id"], len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({v for _, v in at})))] += 1
    assert got == want
    notice = license_scan.NOTICES[0][1].split()
    rows = [(1, " ".join(["word"] * 9 + notice)), (2, " ".join(notice[:10] + ["extra", "words"] + notice[10:])), (3, " ".join(notice[:8])), (4, "of the " * 50)]
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert labels[1] == ("mit", 1.0) and labels[2][0] == "mit" and labels[3] == ("", 0.0) and labels[4] == ("", 0.0)
    assert license_scan.scan(none).count() == 0


def test_license_scan_query_has_the_phrases_of_its_contract(spark, tmp_path):
    rows = [(1, "Released UNDER the\nMIT-License, under the mit license"), (2, "the MIT License"), (3, "apache license version 2 cc-by-nc"), (4, None), (5, "under the mit\u00a0license under the mit license")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = license_scan.op9_license_scan(spark, str(tmp_path)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted(map(tuple, got.collect())) == [(1, 9, 2, 1, 5, "mit"), (2, 3, 0, None, None, ""), (3, 7, 2, 0, 4, "apache-2,cc-by-nc"), (4, 0, 0, None, None, ""), (5, 7, 1, 3, 3, "mit")]


def test_toxicity(spark, odd, none, monkeypatch):
    rng = random.Random(7)
    words_ = ["".join(rng.choices("aeiou", k=2)) + "".join(rng.choices("lmnrst", k=3)) for _ in range(300)]
    rows = []
    for i in range(600):
        text = rng.choices(words_, k=rng.randint(5, 60))
        if i % 3 == 0:
            text.insert(rng.randint(0, len(text)), rng.choice(["grrbad", "zzugly"]))
        rows.append((i, " ".join(text), int(i % 3 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 0, 1), (3, 0, 0), (700, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i, _, _ in rows)
    assert np.mean([got[i]["predicted"] == rows[i][2] for i in held]) > 0.95
    # labels of held-out rows aren't used
    flipped = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, flipped).collect()} == {i: r["score"] for i, r in got.items()}
    strange = toxicity.toxicity(odd, labels).collect()
    assert len(strange) == odd.count() and all(0 <= r["score"] <= 1 for r in strange)
    assert toxicity.toxicity(none, labels).count() == 0
    assert all(r["score"] == 0 for r in toxicity.toxicity(odd, labels.limit(0)).select(F.round("score", 9).alias("score")).collect())
    clean = toxicity.keep_clean(docs.withColumn("score", F.lit("x")).withColumn("text_to_score", F.lit("y")), labels)
    assert clean.columns == ["doc_id", "text", "score", "text_to_score"] and 380 < clean.count() < 420 and clean.where("score <> 'x' or text_to_score <> 'y'").isEmpty()
    # the bound on features keeps the first rows of each label
    monkeypatch.setattr(toxicity, "SAMPLE_FEATURES", 2000)
    assert len(toxicity.toxicity(docs, labels).collect()) == 600


def test_toxicity_by_brute_force(spark):
    """Ratios, weights and scores from their definitions, without numpy's tables."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["ab", "Cd", "bad\n bad", "é", "x", ""], k=rng.randint(0, 12))) for _ in range(60)]
    y = [int("bad" in t) if rng.random() < 0.9 else 1 for t in texts]

    def slots(text):
        t, out = re.sub(b"[ \t\n\r\x0b\x0c]+", b" ", lower(text).encode()), set()
        for n in toxicity.ORDERS:
            for i in range(len(t) - n + 1):
                h = 0
                for b in t[i : i + n]:
                    h = (h * 0x01000193 % 2**32) ^ (b + 1)
                h = h * 0x9E3779B1 % 2**32
                out.add((h ^ (h >> 15)) % (1 << toxicity.BITS))
        return out

    sets = [slots(t) for t in texts]
    learn = [i for i in range(60) if toxicity.fold_of(i) != 0]
    count = [Counter(s for i in learn if y[i] == k for s in sets[i]) for k in (0, 1)]
    n = [sum(y[i] == k for i in learn) for k in (0, 1)]
    ratio = {}
    for s in set(count[0]) | set(count[1]):
        r = math.log((count[1][s] + 1) / (n[1] + 2) / ((count[0][s] + 1) / (n[0] + 2)))
        if count[0][s] + count[1][s] >= 3 and abs(r) > 0.1:
            ratio[s] = r
    # the same steps of the optimiser, one text after another
    w, m, v, b, mb, vb = dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 0.0), 0.0, 0.0, 0.0
    for step in range(1, 41):
        g, gb = {s: w[s] / len(learn) for s in ratio}, 0.0
        for i in learn:
            z = b + sum(w[s] * ratio[s] for s in sets[i] if s in ratio)
            e = (1 / (1 + math.exp(-z)) - y[i]) * 0.5 / (n[y[i]] / len(learn)) / len(learn)
            gb += e
            for s in sets[i]:
                if s in ratio:
                    g[s] += e * ratio[s]
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        for s in ratio:
            m[s], v[s] = 0.9 * m[s] + 0.1 * g[s], 0.99 * v[s] + 0.01 * g[s] ** 2
            w[s] -= 0.02 * (m[s] / c1) / (math.sqrt(v[s] / c2) + 1e-8)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        b -= 0.02 * (mb / c1) / (math.sqrt(vb / c2) + 1e-8)
    want = [1 / (1 + math.exp(-(b + sum(w[s] * ratio[s] for s in sets[i] if s in ratio)))) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    assert all(abs(got[i] - want[i]) < 1e-4 for i in range(60))


def classes_of(texts):
    """Connected classes by exact similarity of shingle sets."""
    sets = []
    for t in texts:
        w = plain_words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_dedup(spark, odd, none, monkeypatch):
    rows = odd.orderBy(F.col("doc_id").asc_nulls_last(), "text").collect()
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(set(classes_of([r["text"] for r in rows])))
    assert {r["class_id"] for r in got if r["doc_id"] in (5, 6)} == {5}
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(classes_of([r["text"] for r in rows])))
    assert near_dedup.near_duplicates(none).count() == 0
    # a family of near copies whose pairs lie around the threshold, with and without the large-bucket way
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    texts = []
    for _ in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(150)] = f"v{rng.randint(0, 10**6)}"
        texts.append(" ".join(w))
    want = classes_of(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for small, block in ((32, 256), (1, 7)):
        monkeypatch.setattr(near_dedup, "SMALL", small)
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()} == dict(enumerate(want))


def library(name):
    """The plain call of the library, apart from the repository's encoders."""
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(default_path(name)).encode
    return lambda text: encode(text, add_special_tokens=False).ids if text else []


SPECIAL = [(801, "one <|endoftext|> two", "a"), (802, "<|startoftext|>", "b"), (803, "It's <|ENDOFTEXT|>  x", None)]


def test_packing(spark, odd, none):
    encode = library("word_bpe_49k.json")
    odd = odd.unionByName(spark.createDataFrame([(i, t, s, "k", 1) for i, t, s in SPECIAL], DOCS))
    got = packing.op3_best_fit_packing
    assert callable(got)
    placed, report = packing.pack(packing.pieces(odd), part_items=4)
    placed = placed.collect()
    want = Counter()
    for r in odd.collect():
        ids = [*encode(r["text"]), 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(r["doc_id"], k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in placed) == want
    rows = defaultdict(list)
    for r in placed:
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in rows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert report.where("packed_bins < bound").isEmpty()
    assert packing.pack(packing.pieces(none))[0].count() == 0


def test_token_output(spark, odd, none, monkeypatch):
    out, encode = fresh_path(spark, "rans"), library("byte_bpe_50k.json")
    odd = odd.unionByName(spark.createDataFrame([(i, t, s, "k", 1) for i, t, s in SPECIAL], DOCS))
    token_output.write(odd, out)
    got = token_output.read(token_output.open_index(spark, out), with_ids=True).orderBy("start").collect()
    at = 0
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in odd.collect()), key=lambda i: -1 if i is None else i)
    texts = Counter(((r["doc_id"]), tuple([*encode(r["text"]), 2])) for r in odd.collect())
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == texts
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        at += r["n_tokens"]
    index = token_output.write(none, fresh_path(spark, "rans"))
    assert token_output.read(index).count() == 0
    # small segments, blocks and files: the same ids
    for name in ("SEGMENT_IDS", "BLOCK_IDS", "FILE_BYTES"):
        monkeypatch.setattr(token_output, name, 1)
    with arrow_rows(spark, 2):
        index = token_output.write(odd.coalesce(1), small := fresh_path(spark, "rans"))
    again = token_output.read(token_output.open_index(spark, small), with_ids=True).orderBy("start").collect()
    assert index.select("file").distinct().count() > 4 and again == got


def test_warc(spark):
    big, text = "<p>" + "é" * 600 + "</p>", "x" * 999
    rows = [(1, "http://a/1", big, "r"), (2, None, big, "r"), (2, None, big, "r"), (3, "u\r\nv", text, "r"), (4, "u", text, "r"), (5, "u", None, "r"), (6, "u", "WARC/1.1\r\n\r\nfoo\r\n\r\n", "r"), (None, "u", big, "r"), (7, "u", "y" * 3_000_000, "r"), (8, "v", "y" * 3_000_000, "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    out = fresh_path(spark, "warc")
    assert warc.write(pages, out) == len(rows)
    got = warc.checked(warc.build_index(spark, out)).collect()
    first = {}
    for i, _, h, _ in rows:
        if len((h or "").encode()) >= 1000:
            first[h] = max(first.get(h, -1), -1 if i is None else i)
    want, seen = Counter(), set()
    for i, _, h, _ in rows:
        p = (h or "").encode()
        held = len(p) < 1000 or (first[h] == i and h not in seen)
        seen |= {h} if held else set()
        want[(i, len(p), hashlib.sha1(p).hexdigest(), "response" if held else "revisit", None if held else first[h])] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    index = warc.build_index(spark, out)
    payloads = {r["page"]: bytes(r["payload"]).decode() for r in warc.fetch(index.where("record_type = 'response'")).collect()}
    assert payloads["6"] == rows[6][2] and payloads["8"] == rows[9][2]
    assert warc.write(pages.limit(0), fresh_path(spark, "warc")) == 0


def test_warc_long_urls_and_small_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "SALT_ROWS", 2)  # groups above it are dealt over salts
    rows = [(i, "http://a/" + "u" * n, "<p>" + "z" * 2000) for i, n in enumerate([70_000, 1_000_000, 5, 65_536, 0, 131_072, 3])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for most in (warc.ARCHIVE_BYTES, 1):
        monkeypatch.setattr(warc, "ARCHIVE_BYTES", most)
        out = fresh_path(spark, "warc")
        assert warc.write(pages, out) == len(rows)
        index = warc.build_index(spark, out)
        assert most > 1 or index.select("file").distinct().count() == len(rows)
        assert {r["page"]: r["url"] for r in index.collect()} == {str(i): u for i, u, _ in rows}
        got = warc.checked(index).collect()
        assert {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got} == {i: ("response", None, 2003) if i == 6 else ("revisit", 6, 2003) for i, _, _ in rows}


def test_embedding_dedup(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 16))
    rows = []
    for i in range(400):
        v = base[rng.integers(0, 30)] + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.15, 0.25])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 3))))
    bad = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, rows[0][1], None), (905, [], 1), (906, rows[0][1][:8], rows[0][2])]
    docs = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(docs).collect()}
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    found = sum(got[i]["n_links"] for i in range(400))
    assert found <= link.sum() and found >= 0.97 * link.sum()
    assert all(got[i]["n_links"] <= link[i].sum() for i in range(400))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 907))
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)
    again = docs.where("vec_id < 5").unionByName(docs.where("vec_id < 5")).unionByName(docs.where("vec_id = 0").withColumn("vec_id", F.lit(None).cast("long")))
    repeated = embedding_dedup.near_duplicates(again).collect()
    assert len(repeated) == 11 and all(r["n_links"] >= 1 for r in repeated)
    assert embedding_dedup.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("grids", [0, 16])
def test_embedding_dedup_by_brute_force(spark, monkeypatch, grids):
    """Planted copies in random and in few directions: with a grid recall is at least 0.99 and no link is counted twice; without one it is 1."""
    rng, rows = np.random.default_rng(9), []
    for i in range(1500):
        v = rng.standard_normal(24)
        v /= np.linalg.norm(v)
        for k in range(int(rng.integers(0, 3))):
            turn = np.zeros(24)
            turn[rng.integers(0, 24, 1 if k else 24)] = rng.standard_normal(1 if k else 24)
            turn *= rng.uniform(0.1, 0.22) / np.linalg.norm(turn)
            rows.append((len(rows), (v + turn).tolist(), i % 3))
        rows.append((len(rows), v.tolist(), i % 3))
    monkeypatch.setattr(embedding_dedup, "CELL_VECTORS", 4)
    monkeypatch.setattr(embedding_dedup, "MOST_GRIDS", grids)
    monkeypatch.setattr(embedding_dedup, "LEFT", 64 if not grids else 5)
    monkeypatch.setattr(embedding_dedup, "RIGHT", 100)
    x, label = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cell", F.lit(1)).withColumn("home", F.lit(1))
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(docs).collect()}
    n = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert link.sum() > 1000 and (n <= link.sum(1)).all() and n.sum() >= (0.99 if grids else 1) * link.sum()


def brute_spans(texts):
    """All (document, word) that stand in a run of 50 words which another document holds too."""
    where, out = defaultdict(set), set()
    for i, w in texts.items():
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(i)
    for i, w in texts.items():
        for k in range(len(w) - 49):
            if len(where[tuple(w[k : k + 50])]) > 1:
                out |= {(i, k + j) for j in range(50)}
    return out


@pytest.mark.parametrize(("parts", "hot"), [(1, 5000), (61, 5000), (1, 0), (61, 0), (61, 3)])
def test_suffix_dedup_by_brute_force(spark, sf_dir, monkeypatch, parts, hot):
    """Also where all or some keys are sorted over range partitions: no word is missed, none is too many."""
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", hot)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        covered = {(r["doc_id"], w) for r in suffix_dedup.repeated_spans(docs).collect() for w in range(r["start_word"], r["end_word"])}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert covered and covered == brute_spans({r["doc_id"]: plain_words(r["text"]) for r in docs.collect()})


def test_suffix_dedup_where_joins_change_while_running(spark, monkeypatch):
    """A join of suffixes with hot keys that is planned with a shuffle and then broadcast doesn't split keys over tasks."""
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 20)
    rng = random.Random(3)
    prose = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    hot, twice = prose(60), [prose(70) for _ in range(40)]
    texts = [prose(30) + x + prose(30) for x in [*twice, *twice, *[hot] * 30]]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "128m"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {(r["doc_id"], w) for r in suffix_dedup.repeated_spans(docs).collect() for w in range(r["start_word"], r["end_word"])}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = brute_spans(dict(enumerate(texts)))
    assert want and got == want


def test_suffix_dedup(odd, none):
    spans = suffix_dedup.repeated_spans(odd).collect()
    assert {r["doc_id"] for r in spans} == {5, 6, 7, 8} and all(r["n_words"] >= 50 for r in spans)
    by = {r["doc_id"]: r for r in spans}
    assert (by[7]["start_word"], by[7]["end_word"], by[7]["other_doc_id"]) == (80, 140, 8) and (by[8]["start_word"], by[8]["end_word"]) == (20, 80)
    assert suffix_dedup.repeated_spans(none).count() == 0


@pytest.mark.parametrize("head", [5, 10, 20, 34, 40])
def test_suffix_dedup_with_a_hot_tail(spark, head):
    """Pairs that share a rare head before words that many documents hold: no word is missed."""
    rng = random.Random(head)
    prose = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    tail, texts = prose(49 if head >= 34 else 50 - head), []
    for _ in range(12):
        shared = prose(head) + tail
        texts += [prose(60) + shared + prose(60) for _ in range(2)]
    texts += [prose(60) + tail + prose(60) for _ in range(60)]
    rng.shuffle(texts)
    want = brute_spans(dict(enumerate(texts)))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], w) for r in suffix_dedup.repeated_spans(docs).collect() for w in range(r["start_word"], r["end_word"])}
    assert want and got == want


def test_near_dedup_with_a_repeated_part(spark):
    """A part that one document repeats doesn't hide the pair: the classes are those of the shingle sets."""
    rng, texts = random.Random(23), []
    for i in range(120):
        w = [f"w{rng.randint(0, 10**9)}" for _ in range(300)]
        other = w[:-1] + ["x"] if i % 2 else w[:284] + [f"v{rng.randint(0, 10**9)}" for _ in range(16)]
        texts += [" ".join(w), " ".join(other[:60] * 50 + other[60:])]
    want = classes_of(texts)
    assert len(set(want)) == 120
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


#: Names that the operators use themselves.
OWN_NAMES = """score text_to_score mixed doc id own_source u least cumulative rate copies copy stretch shuffle_key own part short digest keep_id n_rows salts salt bucket bits text_
rid node n set1 set2 bands band key members centre component elements held other side label_id toxic slots row words size __id __row_id __row_digest __rid __score __text __copy __copies
__order __rate __source __cumulative __u sequence_id offset length bin round item tie url payload page record_type refers_to vector label dim raw cell visits home chunk""".split()


def test_clashing_columns(spark, odd):
    """Columns of any name come through every stage of the pipeline unchanged, and change no other operator's rows."""
    import corpus_pipeline

    wide = odd.select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in OWN_NAMES if n not in odd.columns])
    wide = wide.withColumn("with.dot and `tick`", F.lit("d"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 15)], "doc_id long, toxic int")
    stages = [toxicity.keep_clean(wide, labels), exact_dedup.keep_distinct(wide, "max"), near_dedup.keep_one(wide), near_dedup.keep_one(wide.where("doc_id is not null").dropDuplicates(["doc_id"])), corpus_pipeline.mixed(spark, wide, "")]
    for out in stages:
        assert out.columns == wide.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}:{'-' if r['doc_id'] is None else r['doc_id']}" for r in rows for n in OWN_NAMES if n not in odd.columns) and {r["kept"] for r in rows} == {"k"}
    pages = {"id_col": "doc_id", "url_col": "source", "payload_col": "text"}
    same = lambda make: Counter(map(repr, make(wide).collect())) == Counter(map(repr, make(odd).collect()))
    assert same(exact_dedup.exact_dedup) and same(license_scan.scan) and same(suffix_dedup.repeated_spans) and same(lambda d: warc.records(d, **pages).drop("url"))
    assert same(lambda d: packing.pack(packing.pieces(d))[0].drop("sequence_id", "offset")) and same(lambda d: toxicity.toxicity(d, labels)) and same(lambda d: near_dedup.near_duplicates(d).select("doc_id", "class_id"))


def exact_links(texts):
    """All pairs of different texts whose shingle sets have similarity 0.8 at least, by counting common shingles."""
    sets, where, common = [], defaultdict(list), Counter()
    for i, t in enumerate(texts):
        w = plain_words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
        for x in sets[-1]:
            where[x].append(i)
    for ids in where.values():
        common.update(itertools.combinations(ids, 2))
    return [p for p, n in common.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]


def test_near_dedup_recall_against_all_pairs(spark):
    """On a whole table at least 0.99 of the links are inside a class, and no class joins what links don't."""
    rows = read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.op5_minhash_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    links = exact_links([r["text"] for r in rows])
    found = sum(got[rows[i]["doc_id"]] == got[rows[j]["doc_id"]] for i, j in links)
    assert len(links) > 50 and found >= 0.99 * len(links)
    root = {r["doc_id"]: r["doc_id"] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        a, b = sorted((find(rows[i]["doc_id"]), find(rows[j]["doc_id"])))
        root[b] = a
    assert all(find(c) == find(d) for d, c in got.items())


def test_shared_folder_and_repeated_writes(spark, tmp_path):
    from types import SimpleNamespace

    from lodestone.llm import common, files

    unset = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: {}, master="spark://host:7077"), conf=SimpleNamespace(get=lambda k, d: d))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(unset)
    at = f"file://{tmp_path}/a/b.bin"
    assert files.write_whole(at, [b"x", b"yz"]) == 3 and files.write_whole(at, [b"x", b"yz"]) == 3 and files.read_range(at, 1, 2) == b"yz"
    assert common.unused(["A", "a_", "b"], "a", "c", "B", "c") == ["a__", "c", "B_", "c_"]
    kept = common.stored(spark.range(5).toDF("k"), "five")
    assert {r["k"] for r in filters.near_keys(spark.range(2000).toDF("k"), kept, "k").collect()} >= set(range(5)) and kept.stored_at.startswith(common.shared_dir(spark))
    common.release(kept)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(kept.stored_at)


def test_queries_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf_dir)
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns), name
        assert Counter(map(repr, map(tuple, df.select(*columns).collect()))) == Counter(map(repr, want.fetchall())), name


def test_pipeline_by_brute_force(spark, sf_dir):
    """Every stage's rows, and the whole run's, from plain Python (toxicity by the operator's own scores, which have a test of their own)."""
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_near_dedup", "mix_sources", "best_fit_packing"]
    docs = read_table(spark, sf_dir, "documents")
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    bad = {r["doc_id"] for r in toxicity.toxicity(docs, read_table(spark, sf_dir, "labels")).where("predicted = 1").collect()}
    wanted = {"toxicity": [r for r in rows if r["doc_id"] not in bad]}
    assert bad and wanted["toxicity"]
    last = {lower(r["text"]): r["doc_id"] for r in wanted["toxicity"]}
    wanted["exact_dedup"] = [r for r in wanted["toxicity"] if last[lower(r["text"])] == r["doc_id"]]
    distinct = wanted["exact_dedup"]
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in exact_links([r["text"] for r in distinct]):
        a, b = sorted((find(i), find(j)))
        root[b] = a
    wanted["minhash_near_dedup"] = [r for i, r in enumerate(distinct) if find(i) == i]
    assert len(rows) > len(wanted["toxicity"]) > len(distinct) > len(wanted["minhash_near_dedup"]) > 0
    of = {r["doc_id"]: r for r in rows}
    wanted["mix_sources"] = [of[i] for (i, *_), n in brute_mix(wanted["minhash_near_dedup"]).items() for _ in range(n)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        assert Counter(map(tuple, docs.select(*rows[0].__fields__).collect())) == Counter(map(tuple, wanted[name])), name
    encode, pieces = library("word_bpe_49k.json"), Counter()
    for r in wanted["mix_sources"]:
        ids = [*encode(r["text"]), 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            pieces[(r["doc_id"], k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    out, filled = corpus_pipeline.run(spark, sf_dir).collect(), defaultdict(list)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == pieces
    for r in out:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        assert [o for o, _ in sorted(parts)] == [0, *itertools.accumulate(n for _, n in sorted(parts))][:-1] and sum(n for _, n in parts) <= 2048
