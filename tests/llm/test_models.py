"""Operators with Python code: against brute force, exact round trips, and accuracy on held-out rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from bytemill.llm import langid, packing, pii, ppm, queries, simhash, weak_quality
from tests.conftest import DATA
from tests.llm.util import documents, frame

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = f"{DATA}/sf0.01"


def rows_of(spark, sf=SF):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# --- 1 ---


def check_packing(rows):
    used: dict = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for off, n in sorted(places):
            assert off == at
            at += n
        assert at <= 2048
    return len(used), -(-sum(r["length"] for r in rows) // 2048)


def test_pieces_and_places(spark):
    tok = Tokenizer.from_file(PATH)
    docs = documents() + [(900, "it's <|endoftext|> here, don't", None, None, 0, None, None), (901, "<|startoftext|>", None, None, 0, None, None)]
    wanted = Counter()
    for doc_id, text, *_ in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4").tobytes()
            wanted[doc_id, k, at, len(part) // 4, zlib.crc32(part)] += 1
    got = packing.pack_documents(frame(spark, docs), PATH, keep_ids=True).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == wanted
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in got)
    check_packing(got)
    assert packing.pack_documents(frame(spark, []), PATH).isEmpty()


def test_ids_of_marked_capitals_and_all_documents(spark):
    tok, encoder, rng = Tokenizer.from_file(PATH), packing.Encoder(PATH), random.Random(0)
    letters = "aTtHJWé\u0331\u0308\u030c\u030a \u03a3\u03c3\u03c2\u0130i'sS.,;0 \n\t\x0b\x0c\r\x1c\x85\xa0\u0301K漢ß"
    cases = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(20_000)] + ["T\u0308", "H\u0331 J\u030c. W\u030a,"]
    for t in cases + list(rows_of(spark).values()):
        assert encoder.encode(t.encode()) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_forgotten_words_are_learned_again(spark, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3000)
    tok, encoder = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    for t in list(rows_of(spark).values())[:60]:
        assert encoder.encode(t.encode()) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert len(encoder.known) <= 3000 + len(t)


class Counted:
    """A tokenizer that counts the words it encodes."""

    def __init__(self, tok):
        self.tok, self.n = tok, 0

    def encode_batch_fast(self, words, **k):
        self.n += len(words)
        return self.tok.encode_batch_fast(words, **k)

    def __getattr__(self, name):
        return getattr(self.tok, name)


def test_plain_words_do_not_pass_all_rules(spark):
    encoder, texts = packing.Encoder(PATH), [t for t in rows_of(spark).values() if t]
    encoder.tokenizer = Counted(encoder.tokenizer)
    for t in texts:
        encoder.encode(t.encode())
    words = {w for t in texts for w in t.encode().lower().split()}
    assert len(words) > 10_000 and encoder.tokenizer.n < len(words) // 10


def test_ids_of_plain_words_and_those_beside_them():
    tok, encoder, rng = Tokenizer.from_file(PATH), packing.Encoder(PATH), random.Random(1)
    letters = [chr(k) for k in range(0xC0, 0x100)]
    signs = [chr(k) for k in range(0x21, 0x7F) if not chr(k).isalnum()]
    stems = letters + ["the", "été", "Straße", "ÀÉÎ", "a×b", "a÷", "it's", "l'été", "x7", "½", "e\u0301", "é\u0302", "a…", "»", "ø\u0338", "ǅ", "İ", "क़", "a\xad", "a\x01", "é" * 90, "w" * 90, "w" * 80, "w" * 79]
    tails = [*signs, "", "…", "\u0338", "=\u0338", "...", "'s", "'.", "''s", "$%&", "!" * 90, "7", ".7", ",a", "»."]
    words = [a + b for a in stems for b in tails] + ["".join(rng.choice(letters + signs + list("aehstHS7")) for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
    for text in [w for w in words if "<|" not in w] + [" ".join(words), "\u0301 ".join(words[:3000])]:
        assert encoder.encode(text.encode()) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text[:99]


def test_few_sequences(spark):
    n, least = check_packing(queries.op1_packing(spark, SF).collect())
    assert n <= least + max(1, least // 200)


@pytest.mark.parametrize("seed", range(6))
def test_plans_of_random_histograms(seed):
    rng = random.Random(seed)
    hist = {rng.randint(1, 2048) if seed % 2 else rng.randint(1, 700): rng.randint(1, 400) for _ in range(rng.randint(1, 300))}
    length = np.repeat(np.array(list(hist)), list(hist.values()))
    rank = np.concatenate([np.arange(n) for n in hist.values()])
    s, o = packing.place(packing.plan(hist), length, rank)
    n, least = check_packing([{"sequence_id": a, "offset": b, "length": c} for a, b, c in zip(s.tolist(), o.tolist(), length.tolist(), strict=True)])
    gaps: list[int] = []
    for x in sorted(length.tolist(), reverse=True):  # plain best fit, item by item
        fit = min((g for g in gaps if g >= x), default=None)
        gaps.append((2048 if fit is None else gaps.pop(gaps.index(fit))) - x)
    assert least <= n <= len(gaps) + 1


# --- 7 ---


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    grams = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    f = np.array(fps, np.uint64)
    for k in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[k] ^ f) <= 2):
            root[find(int(j))] = find(k)
    return [find(k) for k in range(len(fps))]


def test_near_groups(spark):
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(3000)).split()
    near = []
    for k in range(40):
        own = list(text)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(3000)] = f"new{k}"
        near.append((500 + k, " ".join(own), None, None, 0, None, None))
    docs = documents() + near
    fps = [brute_fingerprint(r[1]) for r in docs]
    root, least = brute_components(fps), {}
    for r, k in zip(docs, root, strict=True):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    wanted = Counter((r[0], f"{f:016x}", least.get(k)) for r, f, k in zip(docs, fps, root, strict=True))
    got = simhash.near_groups(frame(spark, docs)).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == wanted
    assert len({r["component_id"] for r in got if (r["doc_id"] or 0) >= 500}) < 30
    left = simhash.near_dedup(frame(spark, docs))
    assert {r["doc_id"] for r in left.collect()} == {c for _, _, c in wanted} | {None}
    assert simhash.near_groups(frame(spark, [])).isEmpty()


@pytest.mark.parametrize("few", [200_000, 0])
def test_near_dedup_of_repeated_ids(spark, monkeypatch, few):
    from bytemill.llm import rows

    monkeypatch.setattr(rows, "FEW", few)
    a, b = "one text of several words here", "quite another text with other words"
    docs = [(3, a), (5, a), (5, b), (5, b), (None, a), (None, "a third text which is alone"), (None, "a third text which is alone"), (None, "yet one more text, the fourth")]
    df = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(docs)], "doc_id long, text string, fp int, n string")
    left = simhash.near_dedup(df)
    assert left.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(3, a), (5, b), (None, docs[5][1]), (None, docs[7][1])])


@pytest.mark.parametrize(("crowd", "outright", "crowds"), [(512, 1 << 24, 4096), (4, 1 << 24, 4096), (4, 50, 4096), (4, 1 << 24, 0)])
def test_crowded_anchors_lose_no_link(spark, monkeypatch, crowd, outright, crowds):
    monkeypatch.setattr(simhash, "CROWDS", crowds)
    rng = random.Random(crowd)
    fps = [rng.getrandbits(64)]
    while len(fps) < 900:  # chains and dense balls around one point
        x = rng.choice(fps)
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = list(dict.fromkeys(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    root = brute_components(fps)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "OUTRIGHT", outright)
    found = simhash.linked(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    at = {x: k for k, x in enumerate(signed)}
    mine = list(range(len(fps)))

    def find(a):
        while mine[a] != a:
            a = mine[a]
        return a

    for r in found:
        mine[find(at[r["u"]])] = find(at[r["v"]])
    group = lambda label: sorted(map(sorted, _classes(label).values()))
    assert group([find(k) for k in range(len(fps))]) == group(root)


def _classes(label):
    out: dict = {}
    for k, x in enumerate(label):
        out.setdefault(x, []).append(k)
    return out


def test_codes_cover():
    a, b, c = simhash.blocks()
    fps = np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64)
    for block, radius in ((a, 3), (b, 3), (c, 1)):
        part, syndrome = block.of(fps)
        row, word = block.words(part, syndrome, 0)
        assert (row == np.arange(500)).all() and np.bitwise_count(word ^ part).max() == radius


# --- 8 ---


def brute_scores(docs):
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    low = [(r[0], (r[1] or "").encode().lower()) for r in docs]
    train = [t for i, t in low if not out(i)]
    words: Counter = Counter()
    seen: list[dict] = [{} for _ in range(6)]
    for t in train:
        words.update(t.split())
        words["end"] += 1
        line = b"\xff" * 5 + t + b"\xff"
        for k in range(5, len(line)):
            for n in range(6):
                row = seen[n].setdefault(line[k - n : k], Counter())
                row[line[k]] += 1
    n, v = sum(words.values()), len(words)
    for i, t in low:
        own = [*t.split(), "end"]
        line, score = b"\xff" * 5 + t + b"\xff", 0.0
        for k in range(5, len(line)):
            gone: set = set()
            p = 1.0
            for m in (5, 4, 3, 2, 1, 0):
                row = {s: c for s, c in seen[m].get(line[k - m : k], {}).items() if s not in gone}
                if row:
                    whole = sum(row.values()) + len(row)
                    if line[k] in row:
                        p *= row[line[k]] / whole
                        break
                    p *= len(row) / whole
                    gone |= set(row)
            else:
                p /= 256 - len(gone)
            score += math.log10(p)
        yield i, out(i), len(own), sum(words[w] > 0 for w in own), n, sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own), score


@pytest.mark.parametrize(("cells", "top"), [(ppm.CELLS, ppm.TOP), (2000, 5), (1, 0)])
def test_scores(spark, cells, top):
    docs = [r for r in documents() if len(r[1] or "") < 20_000]
    order = lambda r: (r[0] is None, r[0] or 0, round(r[6], 3))
    got = sorted((tuple(r) for r in ppm.lm_scores(frame(spark, docs), cells, top).collect()), key=order)
    wanted = sorted(brute_scores(docs), key=order)
    assert [r[:5] for r in got] == [r[:5] for r in wanted]
    for a, b in zip(got, wanted, strict=True):
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-6) and a[6] == pytest.approx(b[6], rel=1e-5, abs=1e-4)


def test_hot_contexts_are_split(spark):
    from pyspark.sql import functions as F

    docs = frame(spark, [(k, "aaaaaaaa" + chr(97 + k % 26), "en", "a", 0, None, None) for k in range(2000)])
    order = lambda rows: sorted((r["doc_id"], round(r["score"], 3)) for r in rows)
    assert order(ppm.lm_scores(docs, cells=1000, rows=500).collect()) == order(ppm.lm_scores(docs).collect())
    rows = [(k, at, (0x616161 << 8) + at % 50, 1) for k in range(2000) for at in range(3)] + [(k, 9, (k % 26 << 24) + 97, 2) for k in range(100)]
    need, _ = ppm.deal(spark.createDataFrame(rows, "uid long, at int, w long, n long"), 3, 500)
    sizes = [r["count"] for r in need.groupBy("b", "part").count().collect()]
    assert max(sizes) < 700 and sum(sizes) == len(rows)
    assert max(r["count"] for r in need.groupBy("b").count().collect()) > 2000
    assert need.select("w", "b").distinct().count() == need.select("w").distinct().count()


def test_frequent_contexts_score_where_the_text_is(spark):
    """With half of what the trie would need, most windows are scored at once, and all of them alike."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "river", "house", "green"]) for _ in range(40)) + f" {rng.random()}" for _ in range(60)]
    flat = [t.encode() for t in texts]
    keys = [k for t in flat for _, k in ppm.windows(*ppm.marked(np.frombuffer(t, np.uint8), np.array([0, len(t)])))]
    full = ppm.summed(np.concatenate(keys), np.ones(sum(map(len, keys)), np.int64))
    grams = spark.createDataFrame([(int(w), int(n)) for w, n in zip(*full, strict=True)], "w long, n long")
    symbols = len(np.unique(full[0] & np.uint64(255)))
    some = ppm.frequent(grams, symbols, 20_000)
    part = ppm.Trie(np.zeros(0, np.uint64), np.zeros(0, np.int64), ppm.summed(ppm.tails(full[0], 2), full[1]), some)
    whole = ppm.Trie(*full)
    every = np.concatenate(keys)
    sure = part.known(every)
    assert 0.5 < sure.mean() < 1 and len(some[ppm.ORDER][0]) < len(full[0])
    assert part.cost(every[sure]) == pytest.approx(whole.cost(every[sure]), abs=1e-5)


def test_no_training_rows(spark):
    held = [r for r in documents() if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 and r[1]]
    got = ppm.lm_scores(frame(spark, held[:3])).collect()
    for r in got:
        text = next(h[1] for h in held if h[0] == r["doc_id"])
        assert r["train_tokens"] == r["n_known"] == 0 and r["base_score"] == 0
        assert r["score"] == pytest.approx(-(len(text.encode()) + 1) * math.log10(256), rel=1e-6)
    assert ppm.lm_scores(frame(spark, [])).isEmpty()


def test_probabilities_add_up():
    rng = np.random.default_rng(0)
    line = np.concatenate([np.full(5, 255), rng.integers(0, 6, 3000) * rng.integers(0, 2, 3000), [255]]).astype(np.uint8)
    ((_, keys),) = ppm.windows(line, np.array([0, len(line)]))
    trie = ppm.Trie(*ppm.summed(keys, np.ones(len(keys), np.int64)))
    for context in [*rng.choice(keys, 60) >> np.uint64(8), np.uint64(0x0102030405), np.uint64(0x7777777777)]:
        every = np.uint64(context) << np.uint64(8) | np.arange(256, dtype=np.uint64)
        assert (10.0 ** trie.cost(every).astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_better_than_the_words_alone(spark):
    got = ppm.lm_scores(spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


# --- 10 and 3 ---


def test_languages(spark):
    got = queries.op10_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in got)


def test_languages_of_awkward_rows(spark):
    docs = frame(spark)
    model = langid.fit(docs)
    got = langid.predict(docs, model)
    assert got.count() == len(documents()) and set(docs.columns) <= set(got.columns)
    for r in got.collect():
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not lettered) and (lettered or (r["score"] == 0 and r["rejected"]))
    none = langid.predict(docs, langid.fit(docs.filter("lang = 'no such'")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert langid.predict(frame(spark, []), model).isEmpty()


def test_far_texts_are_rejected(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").select("doc_id", "text", "lang").coalesce(4)
    out = langid.held_out(F.col("doc_id"), 3, 1)
    model = langid.fit(docs.filter(~out))
    rng = random.Random(0)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "".join(map(chr, range(0x4E00, 0x5000)))]
    junk = [" ".join("".join(rng.choices(a, k=rng.randint(2, 9))) for _ in range(150)) for a in alphabets for _ in range(25)]
    got = langid.predict(spark.createDataFrame([(k, t, None) for k, t in enumerate(junk)], docs.schema), model).collect()
    assert sum(r["rejected"] for r in got) >= 0.97 * len(junk)
    kept = langid.predict(docs.filter(out & F.col("text").rlike(r"\p{L}")), model).groupBy((F.length("text") < 200).alias("short")).agg(F.avg(F.col("rejected").cast("int")).alias("gone")).collect()
    assert {r["short"]: r["gone"] < (0.02 if r["short"] else 0.001) for r in kept} == {True: True, False: True}
    short = ["The house is there.", "That is the one.", "Les maisons dans la ville.", "Die Stadt und der Berg."]
    assert not any(r["rejected"] for r in langid.predict(spark.createDataFrame([(k, t, None) for k, t in enumerate(short)], docs.schema), model).collect())
    foreign = langid.predict(docs.filter("lang = 'de' and length(text) > 1000"), langid.fit(docs.filter("lang <> 'de'")))
    assert foreign.agg(F.avg(F.col("rejected").cast("int"))).first()[0] > 0.5


def test_prediction_equals_plain_cosines(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    model = langid.fit(docs)
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    fold = lambda b: b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32
    for r in langid.predict(docs, model).orderBy("doc_id").limit(50).collect():
        if r["lang_pred"] == "und":
            continue
        t = [32, *map(fold, text[r["doc_id"]]), 32]
        n = Counter(((t[k - 1] | t[k] << 8 | t[k + 1] << 16) * 2654435761 & 0xFFFFFFFF) >> 20 for k in range(1, len(t) - 1) if t[k] != 32)
        x = {k: math.sqrt(c) * model.idf[k] for k, c in n.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        cos = [sum(v * c[k] for k, v in x.items()) / norm for c in model.centroids]
        assert r["score"] == pytest.approx(max(cos), abs=1e-4) and max(c for c, g in zip(cos, model.langs, strict=True) if g == r["lang_pred"]) >= max(cos) - 1e-5


def test_samples_are_bounded(spark):
    from pyspark.sql import functions as F

    from bytemill.llm.rows import drawn

    same = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 7).cast("long").alias("doc_id"), F.lit("one text of one id").alias("text"), F.lit("en").alias("lang"))
    assert drawn(same, "langid", F.lit(1.0)).count() == 2
    some = spark.range(20_000).select("id", F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    assert 800 < drawn(some, "langid", F.lit(0.05)).count() < 1200
    assert langid.predict(same, langid.fit(same)).filter("lang_pred <> 'en'").isEmpty()
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("words of a text").alias("text"), F.col("id").cast("string").alias("lang"))
    assert len(set(langid.fit(many).langs)) <= langid.LANGUAGES


def test_clashing_columns_pass_the_pipeline_stages(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").withColumns({c: F.lit(42) for c in ("score", "lang_pred", "rejected", "kept", "size", "copies", "_row", "fp")})
    for _, step in corpus_pipeline.STAGES[:4]:
        out = step(spark, docs, "")
        assert out.columns == docs.columns
        assert out.filter(" or ".join(f"{c} <> 42" for c in ("score", "lang_pred", "rejected", "kept", "size", "copies", "_row", "fp"))).isEmpty() and not out.isEmpty()


def test_trigram_counts_cross_blocks(monkeypatch):
    text = random.Random(0).randbytes(5000)
    flat, starts = np.frombuffer(text, np.uint8), np.array([0, 7, 7, 2500, 5000])
    whole = langid.counts(flat, starts)
    monkeypatch.setattr(langid, "BLOCK", 100)
    assert (langid.counts(flat, starts) == whole).all()


def test_weak_quality(spark):
    got = queries.op3_weak_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in got) >= 0.97 * len(got)
    assert sum(r["kept"] for r in got if r["quality"]) >= 0.98 * sum(r["quality"] for r in got)
    odd = weak_quality.score(frame(spark))
    assert odd.count() == len(documents())
    assert all(r["score"] == r["posterior"] == 0 and not r["kept"] for r in odd.filter("text is null or trim(text) = ''").collect())
    assert weak_quality.score(frame(spark, [])).isEmpty()


def test_accuracies_are_found():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    right = (0.95, 0.9, 0.8, 0.6)
    votes = [np.where(rng.random(20_000) < 0.2, 2, np.where(rng.random(20_000) < a, good, ~good)) for a in right]
    keys = list(zip(*(v.tolist() for v in votes), strict=True))
    posterior = weak_quality.estimate(Counter(keys))
    guess = np.array([posterior[k] >= 0.5 for k in keys])
    assert (guess == good).mean() > 0.93


def test_posterior_equals_plain_rounds():
    rng = random.Random(4)
    patterns = {tuple(rng.choice((0, 1, 2, 2)) for _ in range(4)): rng.randint(1, 50) for _ in range(40)}
    good = {k: 0.05 if k.count(0) > k.count(1) else 0.95 for k in patterns}
    total = sum(patterns.values())
    for _ in range(100):
        mass = sum(n * good[k] for k, n in patterns.items())
        prior = min(0.95, max(0.05, (mass + 1) / (total + 2)))
        new = {}
        for k in patterns:
            odds = math.log(prior / (1 - prior))
            for j, vote in enumerate(k):
                if vote < 2:
                    of = lambda c: sum(n * (good[q] if c else 1 - good[q]) for q, n in patterns.items())
                    cast = lambda c: sum(n * (good[q] if c else 1 - good[q]) for q, n in patterns.items() if q[j] == vote)  # noqa: B023, E731
                    rate = [(cast(c) + 0.5) / (of(c) + 1) for c in (vote, 1 - vote)]
                    odds += (1 if vote else -1) * max(0.0, math.log(rate[0] / rate[1]))
            new[k] = 1 / (1 + math.exp(-max(-50, min(50, odds))))
        if max(abs(new[k] - good[k]) for k in new) < 1e-9:
            break
        good = new
    assert weak_quality.estimate(patterns) == pytest.approx(good, abs=1e-6)


# --- 5 ---

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(t):
    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    return {k: [m.span() for m in re.finditer(p, t) if good(k, m[0])] for k, p in BASE.items()}


def test_base_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("ab.@-+ 0123456789()%é\n") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_spans(t)
    assert pii.base_spans("9" * 30_000 + "a" * 30_000)["card"] == []


def test_personal_data(spark):
    import hashlib

    texts = rows_of(spark)
    for r in queries.op5_pii(spark, SF).collect():
        t = texts[r["doc_id"]]
        base = brute_spans(t)
        told = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b in base[k])
        assert [r[f"n_{k}"] for k in BASE] == [len(base[k]) for k in BASE]
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert set(filter(None, told.split(","))) <= set(r["spans"].split(","))
        for m in re.finditer(r'token = "([0-9a-f]+)"', t):
            assert ["secret", str(m.start(1)), str(m.end(1))] in spans
        if not re.search("[0-9@]", t):
            assert not spans


def test_field_on_unseen_examples():
    w = pii.trained()
    hit = want = extra = 0
    for text, spans in pii.examples(300, seed=99):
        got = {x for run in pii.islands(text) for x in pii.best(text, run, w)}
        hit, want, extra = hit + len(got & set(spans)), want + len(spans), extra + len(got - set(spans))
    assert hit >= 0.9 * want and extra <= 0.03 * want


def test_field_finds_the_best_segmentation():
    """Against all segmentations of short runs, with the trained weights and with random ones."""
    rng = random.Random(6)
    w = pii.trained()
    for n in range(60):
        text = " ".join(rng.choice(["call", "4111", "1111", "+1", "555-1234", "(212)", "a@b.co", "10.0.0.1", "token", "zz9", "7", "and"]) for _ in range(rng.randint(1, 6)))
        weights = w if n % 2 else {(k, f): rng.uniform(-2, 2) for k in pii.KINDS for f in ("any", "tokens1", "tokens2", "digits1", "digits2", "length4", "length5", "loose", "call")}
        for run in pii.islands(text):
            spans = [(i, j, sum(weights.get((k, f), 0.0) for f in fs), (k, a, b)) for i, j, a, b, fs in pii._lattice(text, run) for k in pii.KINDS]

            def every(at, spans=spans, run=run):
                if at >= len(run):
                    yield 0.0, []
                    return
                yield from every(at + 1)
                for i, j, s, span in spans:
                    if i == at:
                        for rest, more in every(j):
                            yield s + rest, [span, *more]

            top = max(x for x, _ in every(0))
            got = pii.best(text, run, weights)
            score = {span: s for _, _, s, span in spans}
            assert sum(score[x] for x in got) == pytest.approx(top, abs=1e-9)


def test_long_words_before_a_span_count():
    word = "x" * 5000
    assert pii._words_before(f"one {word}  two ", len(word) + 10) == [word, "two"] and pii._words_before("a", 0) == []


def test_personal_data_of_awkward_rows(spark):
    assert pii.personal_data(frame(spark)).count() == len(documents()) and pii.personal_data(frame(spark, [])).isEmpty()


# --- the pipeline ---


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, columns = docs, docs.columns
    for name, step in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] or "" for r in kept.collect()}
        step(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        after = [r["doc_id"] for r in kept.collect()]
        if name == "sequences":
            assert set(after) == set(before)
            check_packing(kept.collect())
            continue
        assert kept.columns == columns
        if name == "language":
            assert set(after) == {k for k, t in before.items() if any(c.isalpha() for c in t)}
        elif name == "exact_copies":
            best: dict = {}
            for k, t in before.items():
                key = re.sub(r"[\x20\x09-\x0D]", "", t)
                best[key] = min(best.get(key, (1, 0)), (-len(t), k))
            assert sorted(after) == sorted(k for _, k in best.values())
        elif name == "near_copies":
            ids = sorted(before)
            root = brute_components([brute_fingerprint(before[k]) for k in ids])
            assert sorted(after) == sorted(min(ids[j] for j in own) for own in _classes(root).values())
        else:
            assert set(after) <= set(before) and max(Counter(after).values()) <= 3
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept.count()
