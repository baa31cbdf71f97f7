"""Operators without Python on the executors: against SQL on small tables, and on hand-made rows."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bytemill.llm import exact_dedup, line_dedup, mixing, quality_rules, queries
from bytemill.llm.graph import components
from tests.conftest import DATA
from tests.llm.util import documents, frame
from tests.same import assert_same, oracle

BLANK = r"[\x20\x09-\x0D]"


@pytest.mark.parametrize("name", queries.SQL)
def test_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas(), oracle(queries.SQL[name], f"{DATA}/sf0.001"))


@pytest.mark.parametrize("name", ["op2_mixing", "op4_quality_rules", "op6_exact_dedup", "op9_line_dedup"])
def test_plans_hold_no_python(spark, name):
    plan = queries.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_exact_dedup_of_awkward_rows(spark, monkeypatch):
    rows = documents()
    digest = lambda t: hashlib.sha256(re.sub(BLANK, "", t or "").encode()).hexdigest()
    order = lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)
    groups: dict = {}
    for r in rows:
        groups.setdefault(digest(r[1]), []).append(r)
    for few in (512, 2):  # all groups are frequent, or hardly any
        monkeypatch.setattr(exact_dedup, "CANDIDATES", few)
        got = exact_dedup.exact_groups(frame(spark)).collect()
        assert len(got) == len(rows)
        for r in got:
            group = groups[r["text_sha256"]]
            assert (r["keep_id"], r["group_size"]) == (min(group, key=order)[0], len(group))
        assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(groups.keys())
        left = exact_dedup.exact_dedup(frame(spark))
        assert left.columns == frame(spark).columns
        assert sorted(digest(r["text"]) for r in left.collect()) == sorted(groups)
    assert exact_dedup.exact_groups(frame(spark, [])).isEmpty() and exact_dedup.exact_dedup(frame(spark, [])).isEmpty()


def fill(sizes: dict, most: int = 3) -> dict:
    """Targets by sharing out again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        left, free = total - sum(capped.values()), [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}


def test_mixing_of_awkward_rows(spark):
    rows = documents()
    size: Counter = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    wanted = fill(size)
    mixed = mixing.with_copies(mixing.sized(frame(spark)))
    got = mixed.collect()
    assert len(got) == len(rows) and "kept" in mixed.columns
    for r in got:
        assert r["size"] == len(words(r["text"])) and r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(wanted[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
    taken: Counter = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    for s in size:  # within the error of sampling
        f = wanted[s] / size[s] % 1 if size[s] else 0
        assert abs(taken[s] - wanted[s]) <= 4 * (f * (1 - f) * sum(r["size"] ** 2 for r in got if r["source"] == s)) ** 0.5 + 1e-6
    copies = mixing.mix(frame(spark))
    assert copies.columns == frame(spark).columns and copies.count() == sum(r["copies"] for r in got)
    again = {(r["doc_id"], r["text"]): r["copies"] for r in mixing.with_copies(mixing.sized(frame(spark).repartition(7))).collect()}
    assert again == {(r["doc_id"], r["text"]): r["copies"] for r in got}
    assert mixing.mix(frame(spark, [])).isEmpty()


def test_extra_copies_come_at_the_fraction(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")
    per = mixing.with_copies(mixing.sized(docs)).groupBy("source", "source_size", "target").agg(
        F.count(F.lit(1)).alias("n"), F.sum("copies").alias("c"), F.sum("taken").alias("taken"), F.sum(F.col("size") * F.col("size")).alias("squares"))
    for r in per.collect():
        rate = r["target"] / r["source_size"]
        f = rate % 1
        assert abs(r["c"] / r["n"] - rate) <= 4 * (f * (1 - f) / r["n"]) ** 0.5 + 1e-9
        assert abs(r["taken"] - r["target"]) <= 4 * (f * (1 - f) * r["squares"]) ** 0.5 + 1e-6


def test_draws_of_null_ids_differ(spark):
    rows = [(None, f"w w w w w text {k}", None, "b", 0, None, None) for k in range(300)] + [(k, "w " * 2, None, "a", 0, None, None) for k in range(300)]
    got = [r["copies"] for r in mixing.with_copies(mixing.sized(frame(spark, rows))).collect() if r["doc_id"] is None]
    assert len(set(got)) == 2


def test_mixing_with_many_sources(spark, monkeypatch):
    plain = {(r["doc_id"], r["source"]): r["taken"] for r in mixing.with_copies(mixing.sized(frame(spark))).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert plain == {(r["doc_id"], r["source"]): r["taken"] for r in mixing.with_copies(mixing.sized(frame(spark))).collect()}


def test_mixing_caps_and_wordless_sources(spark):
    rows = [(k, "w " * n, None, s, 0, None, None) for k, (s, n) in enumerate([("a", 5), ("b", 1000), ("c", 0), ("d", 3), (None, 40)])]
    got = {r["source"]: r["target"] for r in mixing.with_copies(mixing.sized(frame(spark, rows))).collect()}
    assert got == pytest.approx(fill({"a": 5, "b": 1000, "c": 0, "d": 3, None: 40})) and got["a"] == 15 and got["c"] == 0


def test_quality_of_awkward_rows(spark):
    got = quality_rules.quality_rules(frame(spark)).collect()
    assert len(got) == len(documents())
    for r in got:
        t, w = r["text"] or "", words(r["text"])
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {q for k in range(len(w) - 2) if grams[w[k], w[k + 1], w[k + 2]] > 1 for q in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(hit))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r["kept"] and r["base_failed"])
    assert quality_rules.quality_rules(frame(spark, [])).isEmpty()


def test_quality_agrees_with_labels(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").join(spark.read.parquet(f"{DATA}/sf0.01/labels.parquet"), "doc_id")
    got = quality_rules.quality_rules(docs).filter("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.05 * n[0, False]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near_lines(seed=5):
    rng = random.Random(seed)

    def changed(line, k):
        x = list(line)
        for _ in range(k):
            at = rng.randrange(len(x) + 1)
            x[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "é"])
        return "".join(x)

    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(3, 60))).strip() or "q" for _ in range(40)]
    pool = base + [changed(rng.choice(base), rng.randint(0, 4)) for _ in range(160)]
    return sorted({p.strip() for p in pool if p.strip()}), rng


@pytest.mark.parametrize("crowd", [32, 2])
def test_near_lines_lose_no_link(spark, monkeypatch, crowd):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    lines, _ = near_lines()
    long = [x for x in lines if len(x) >= line_dedup.SHORTEST]
    df = spark.createDataFrame([(x,) for x in long], "line string").withColumn("id", F.xxhash64("line"))
    name = {r["id"]: r["line"] for r in df.collect()}
    met = {frozenset((name[r["u"]], name[r["v"]])) for r in line_dedup.candidates(df).collect()}
    need = {frozenset((a, b)) for a in long for b in long if a < b and abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2}
    assert need and need <= met


def test_banded_distance(spark):
    lines, rng = near_lines(9)
    pairs = [(a, rng.choice(lines)) for a in lines] + [(a, a[:-1] + "zz") for a in lines] + [("ab", "ab"), ("abc", "abcdef")]
    df = spark.createDataFrame([p for p in pairs if p[1]], "a string, b string").withColumn("near", line_dedup.within(F.col("a"), F.col("b")))
    for r in df.collect():
        assert r["near"] == (edits(r["a"], r["b"]) <= 2)


def test_line_counts_and_clean_texts(spark):
    lines, rng = near_lines(3)
    docs = [(k, "\n".join(" " + rng.choice(lines) for _ in range(rng.randint(0, 6)))) for k in range(50)]
    docs[3] = (3, None)
    lines = sorted({x.strip() for _, t in docs for x in (t or "").split("\n") if x.strip()})
    group = {x: {x} for x in lines}
    for a in lines:
        for b in lines:
            if a < b and min(len(a), len(b)) >= 16 and group[a] is not group[b] and edits(a, b) <= 2:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    seen: set = set()
    wanted, clean = {}, {}
    for k, t in docs:
        own = [x.strip() for x in (t or "").split("\n") if x.strip()]
        stay = []
        for x in own:
            if not seen & group[x]:
                stay.append(x)
            seen.add(x)
        wanted[k], clean[k] = (len(own), len(own) - len(stay)), "\n".join(stay)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in line_dedup.line_counts(df).collect()} == wanted
    assert {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(df).collect()} == clean
    assert line_dedup.line_counts(frame(spark)).count() == len(documents()) and line_dedup.line_counts(frame(spark, [])).isEmpty()


def test_rows_that_repeat_ids_are_documents_of_their_own(spark):
    a, b, c = "a line that two rows hold, both", "another line, of one row only.", "a line that two rows hold, bath"
    docs = [(7, a), (7, b + "\n" + c), (None, a), (None, a), (None, a + "\n" + a), (9, None)]
    df = spark.createDataFrame([(*r, k, "extra") for k, r in enumerate(docs)], "doc_id long, text string, keep int, root string")
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["n_lines"], r["n_removed"], r["n_shared"], tuple(r["first_ids"])) for r in line_dedup.line_counts(df).collect()), key=str)
    assert [g[2:4] for g in got if g[0]] == [(1, 1), (1, 1), (2, 2)] and all(g[5] == (7,) for g in got if g[0])
    own = [g[2:] for g in got if g[1] == 7]
    assert sorted(own) == [(1, 0, 1, (7,)), (2, 1, 1, (7,))] and [g[2:] for g in got if g[1] == 9] == [(0, 0, 0, ())]
    clean = line_dedup.line_dedup(df)
    assert clean.columns == df.columns
    assert {r["keep"]: r["text"] for r in clean.collect()} in ({0: a, 1: b, 2: "", 3: "", 4: "", 5: ""}, {0: "", 1: b + "\n" + c, 2: "", 3: "", 4: "", 5: ""})


def test_links_are_counted(spark):
    docs = [(1, "the quick brown fox jumps"), (2, "the quick brown fox jumpz"), (3, "the quick brown fox jum"), (4, "nothing like the others at all")]
    got = {r["doc_id"]: (r["n_links"], tuple(r["first_ids"])) for r in line_dedup.line_counts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (2, (1,)), 2: (2, (1,)), 3: (2, (1,)), 4: (0, ())}


@pytest.mark.parametrize("few", [200_000, 0])
def test_exact_dedup_of_repeated_ids(spark, monkeypatch, few):
    from bytemill.llm import rows

    monkeypatch.setattr(rows, "FEW", few)
    docs = [(3, "A x"), (5, "Ax"), (5, "B unlike"), (5, "B unlike"), (None, "C"), (None, "C"), (None, "D"), (None, None), (8, " ")]
    df = spark.createDataFrame([(*r, k, "t") for k, r in enumerate(docs)], "doc_id long, text string, kept int, _n string")
    left = exact_dedup.exact_dedup(df)
    assert left.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(3, "A x"), (5, "B unlike"), (None, "C"), (None, "D"), (8, " ")])


def test_components(spark):
    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(0, 120)] + [(200, k) for k in range(201, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    root = {k: k for p in pairs for k in p}
    for _ in range(130):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["v"]: r["u"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert all(got.get(k, k) == r for k, r in root.items())
    assert components(spark.createDataFrame([], "u long, v long")).isEmpty()
