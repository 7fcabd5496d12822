"""Every operator against a plain version, and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import ODD, SCHEMA
from pyspark.sql import functions as F

from prosemill.llm import common, components, decontaminate, language_model, licenses, mixing, quality, repetition, sharding, simhash, substring, toxicity


def words(t):
    return t.encode().split() if t else []


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1


def test_blocks_cover_five_of_eight():
    assert len(simhash.blocks()) == 14
    for five in itertools.combinations(range(8), 5):
        assert sum(set(b) <= set(five) for b in simhash.blocks()) == 1


def test_hash_is_the_engines(spark):
    import xxhash

    assert spark.range(1).select(F.xxhash64(F.lit("abc déf ghi"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest("abc déf ghi".encode(), 42)


def plain_fingerprint(text):
    """By the definition, bit by bit, with another binding of the hash."""
    from xxhash import xxh64

    x = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    grams = [b" ".join(x[i : i + 3]) for i in range(len(x) - 2)] or ([b" ".join(x)] if x else [])
    hashes = [int(xxh64(g, seed=42).hexdigest(), 16) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(docs):
    fp = [plain_fingerprint(t) for _, t, *_ in docs]
    label = list(range(len(docs)))
    while True:
        new = [min(label[j] for j in range(len(docs)) if (fp[i] ^ fp[j]).bit_count() <= 3) for i in range(len(docs))]
        if new == label:
            break
        label = new
    ids = {k: min((docs[i][0] for i in range(len(docs)) if label[i] == k and docs[i][0] is not None), default=None) for k in set(label)}
    return sorted(((d[0], f"{f:016x}", ids[k]) for d, f, k in zip(docs, fp, label)), key=repr)


def test_simhash_against_all_pairs(make):
    r, docs = random.Random(3), []
    for g in range(30):
        base = prose(g, 150).split()
        for _ in range(r.randint(1, 6)):
            own = list(base)
            if r.random() < 0.7:
                own[r.randrange(len(own))] = "edited"
            docs.append((len(docs), " ".join(own)))
    docs += [(1000 + (i or 0) if i is not None else None, t) for i, t, *_ in ODD]
    assert rows(simhash.near_duplicates(make(docs)).select("doc_id", "fingerprint", "component_id")) == plain_classes(docs)


def test_simhash_long_lists(make, monkeypatch):
    monkeypatch.setattr(simhash, "SHORT_LIST", 2)
    monkeypatch.setattr(simhash, "BLOCK", 4)
    base = prose(1, 120).split()
    docs = [(i, " ".join(base[: i % 40] + [f"e{i}"] + base[i % 40 + 1 :])) for i in range(60)]
    assert rows(simhash.near_duplicates(make(docs)).select("doc_id", "fingerprint", "component_id")) == plain_classes(docs)


def test_simhash_keeps_one_of_each(make):
    docs = [(5, prose(1, 90)), (3, prose(1, 90)), (9, prose(2, 90)), (9, prose(2, 90)), (7, None), (8, "")]
    assert sorted(r[0] for r in simhash.keep_one(make(docs)).select("doc_id").collect()) == [3, 7, 9]
    assert simhash.keep_one(make([])).count() == 0
    clash = make(docs).withColumn("fingerprint", F.lit("mine")).withColumn("fp", F.lit(1)).withColumn("class_fp", F.lit(2))
    assert simhash.near_duplicates(clash).filter("fingerprint = 'mine'").count() == 0


def test_simhash_keeps_unrelated_rows_of_one_id(make):
    a, b = prose(101, 80), prose(202, 80)
    got = simhash.keep_one(make([(1, a), (1, b), (2, a), (3, b)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(1, a), (1, b)])


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (3, 2), (7, 7), (9, 8), (8, 9)]
    found = dict(rows(components.components(spark.createDataFrame(edges, "u long, v long"))))
    assert {found[i] for i in range(100, 161)} == {100} and found[3] == found[2] == 1 and found[9] == 8 and 7 not in found


# 2


def test_hilbert_neighbours_touch(spark):
    for dims, bits in ((2, 3), (3, 3), (4, 2)):
        names = [f"c{i}" for i in range(dims)]
        df = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=dims)), ", ".join(f"{c} int" for c in names))
        path = sorted((r[-1], *r[:-1]) for r in df.withColumn("h", sharding.hilbert_index([F.col(c) for c in names], bits)).collect())
        assert [p[0] for p in path] == list(range(1 << bits * dims))
        assert all(sum(abs(a - b) for a, b in zip(p[1:], q[1:])) == 1 for p, q in zip(path, path[1:]))


@pytest.mark.parametrize("n", [0, 1, 23, 24, 500])
def test_shards_are_even_and_gapless(make, n):
    docs = make([(i, prose(i, i % 50), f"s{i % 7}" if i % 3 else "hot") for i in range(n)] + (ODD if n else []))
    out = sharding.shard(sharding.sized(docs), ["source", "lang", "size"]).toPandas()
    assert len(out) == (n + len(ODD) if n else 0)
    counts = Counter(out["shard"])
    if n:
        every = [counts.get(k, 0) for k in range(24)]
        assert max(every) - min(every) <= 1
    for k, own in out.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


def plain_curve(levels, bits):
    """Place of a point on the curve: its quadrant's place among the quadrants in their order, then the rest turned into the quadrant's frame."""
    x, n = list(levels), len(levels)
    q = 1 << bits - 1
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0], x[i] = x[0] ^ t, x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    q = 1 << bits - 1
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return int("".join(str(v >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def test_shards_against_a_plain_sort(make):
    r = random.Random(7)
    docs = [(i, prose(i, r.choice([0, 1, 3, 9, 40, 200])), r.choice(["s1", "s1", "s1", "s2", "s3", None])) for i in range(500)] + ODD
    df = make(docs)
    out = sharding.shard(sharding.sized(df), ["source", "size"]).collect()

    def steps(values, step):
        known = [v for v in values if v is not None]
        return [0 if v is None else 1 + step(v, min(known), max(known)) for v in values]

    def of_number(v, lo, hi):
        x = v - lo + 1
        top = x.bit_length() - 1
        return top * 64 + ((x << 6 >> top) & 63)

    def of_string(v, lo, hi):
        skip = len(os.path.commonprefix([lo, hi]))
        num = lambda t: int.from_bytes(t.encode()[skip : skip + 6].ljust(6, b"\0"), "big")
        width = -(-(num(hi) - num(lo) + 1) // 4095)
        return (num(v) - num(lo)) // width

    both = [steps([row["source"] for row in out], of_string), steps([row["size"] for row in out], of_number)]
    levels = [[sum(y < x for y in s) * 16 // len(s) for x in s] for s in both]
    cell = [plain_curve(p, 4) for p in zip(*levels)]
    order = sorted(range(len(out)), key=lambda k: (out[k]["shard"], out[k]["slot"]))
    assert [cell[k] for k in order] == sorted(cell)
    assert [out[k]["shard"] for k in order] == [k * 24 // len(out) for k in range(len(out))]
    again = {(x["doc_id"], x["text_crc32"], x["shard"], x["slot"]) for x in sharding.shard(sharding.sized(df.repartition(7)), ["source", "size"]).collect()}
    assert {(x["doc_id"], x["text_crc32"], x["shard"], x["slot"]) for x in out} == again


def test_one_huge_size_leaves_the_others_apart(make):
    docs = make([(i, "x" * (i % 50) * 10, "s") for i in range(400)] + [(999, "y" * 3_000_000, "s")])
    out = sharding.shard(sharding.sized(docs), ["size"]).toPandas()
    spread = sorted(out.groupby("shard")["size"].agg(lambda x: x.max() - x.min()))
    # Only the shard that holds it is wide; any other lies in two of the 16 levels at most, of some 31 bytes each.
    assert spread[-1] > 2_000_000 and spread[-2] <= 62


def test_shard_order_follows_the_curve_and_prunes(make):
    docs = make([(i, prose(i, 10 + i % 90), f"s{i % 8}") for i in range(800)])
    out = sharding.sharded(docs.withColumn("slot", F.lit("mine"))).toPandas()
    assert out.groupby("shard")["source"].nunique().mean() < 5
    assert list(out.columns) == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    assert sorted(out["text"]) == sorted(r[0] for r in docs.select("text").collect())


# 3


def plain_repeats(docs, w=20):
    seen = {}
    for i, t in docs:
        x = words(t)
        for s in range(len(x) - w + 1):
            seen.setdefault(tuple(x[s : s + w]), []).append((i is None, i or 0, s))
    out = []
    for i, t in docs:
        x = words(t)
        gone = set()
        for s in range(len(x) - w + 1):
            if min(seen[tuple(x[s : s + w])]) < (i is None, i or 0, s):
                gone |= set(range(s, s + w))
        kept = b" ".join(v for k, v in enumerate(x) if k not in gone)
        out.append((i, len(x), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_substring_against_all_windows(make):
    r = random.Random(5)
    passages = [prose(100 + k, r.randint(18, 70)) for k in range(12)]
    docs = [(i, " ".join(x for _ in range(r.randint(0, 4)) for x in (prose(r.random(), r.randint(0, 40)), r.choice(passages)))) for i in range(120)]
    docs += [(3, docs[3][1]), (200, docs[7][1]), (201, docs[7][1]), *((i, t) for i, t, _ in ODD if i != 3)]
    for tree_rows in (200_000, 6, 0):  # none, some and all prefixes are lengthened
        got = substring.remove_repeats(make(docs), group_bytes=2000, tree_rows=tree_rows).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256))
        assert rows(got) == plain_repeats(docs)
    assert substring.remove_repeats(make([])).count() == 0


def test_substring_shuffles_the_texts_once(spark, make):
    def sent():
        """Rows that each stage has sent, by its number; old stages may drop out."""
        sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
        sc.listenerBus().waitUntilEmpty()
        none = jvm.java.util.ArrayList()
        stages = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    docs, before = make([(i, "too short for a window") for i in range(3000)]), sent()
    assert substring.remove_repeats(docs).agg(F.sum("n_words")).first()[0] == 15000
    assert 3000 <= sum(n for k, n in sent().items() if k > max(before, default=-1)) < 3100


def test_suffix_tree_nodes():
    x = np.array([[1, 2, 3], [1, 2, 4], [1, 2, 3], [0, 2, 3], [1, 2, 3]], np.uint32)
    order, lcp = substring.suffix_array(x, np.array([5, 5, 5, 5, 6], np.uint64), [np.arange(5)[::-1]])
    assert list(order) == [3, 2, 0, 4, 1] and list(lcp) == [0, 0, 4, 3, 2]
    assert list(substring.deep_nodes(lcp, 4)) == [0, 1, 1, 3, 4] and list(substring.deep_nodes(lcp, 2)) == [0, 1, 1, 1, 1]


# 4


def plain_repeat_words(x, k):
    n = Counter(tuple(x[s : s + k]) for s in range(len(x) - k + 1))
    return len({s + o for s in range(len(x) - k + 1) if n[tuple(x[s : s + k])] > 1 for o in range(k)})


def test_repetition_against_windows(make):
    r = random.Random(9)
    docs = [(i, "\n".join(prose(r.randrange(6), r.randint(1, 30), 6) for _ in range(r.randint(0, 6))) + "#" * (i % 3)) for i in range(80)]
    docs += [(i, t) for i, t, _ in ODD] + [(500, "same line of words here now\n" * 40), (501, " ".join(["a"] * 300))]
    got = repetition.repetition_rules(make(docs)).select("doc_id", "rules.*").collect()
    want = []
    for i, t in docs:
        x = words(t)
        longest = max((k for k in range(1, len(x)) if plain_repeat_words(x, k)), default=0) if len(x) < 400 else len(x) - 2
        own = plain_repeat_words(x, repetition.MIN_REPEAT)
        base = plain_repeat_words(x, 8)
        lines = [q for q in (t or "").split("\n") if words(q)]
        failed = len(x) < 20 or 100 * base > 30 * len(x)
        want.append((i, len(x), len(b"".join(x).decode()), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), base, own, longest, failed, not failed and 100 * own <= 30 * len(x) and longest <= 100))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


# 5


def labelled(spark, n, value_of):
    return spark.createDataFrame([(i, value_of(i), value_of(i)) for i in range(n)], "doc_id long, quality int, toxic int")


def test_cotraining_on_held_out_rows(spark, make):
    bad = lambda i: i % 4 == 0
    docs = make([(i, " ".join(w + ("%%%" if bad(i) else "") for w in prose(i, 60).split())) for i in range(400)] + [(1000 + k, d[1]) for k, d in enumerate(ODD)])
    model = quality.fit(docs, labelled(spark, 300, lambda i: int(not bad(i))))
    got = {r["doc_id"]: r["quality_score"] for r in quality.scored(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 410
    assert np.mean([(got[i] >= 0.5) != bad(i) for i in range(300, 400)]) > 0.95


def test_empty_tables_and_clashing_columns(spark, make):
    none, some = make([]), make([(1, "one two three " * 9, "s"), (2, None, None)])
    labels, items = labelled(spark, 0, int), spark.createDataFrame([], "item_id long, text string")
    clash = some.withColumns({c: F.lit("mine") for c in ("rules", "toxicity", "license", "quality_score", "hits", "g", "part", "kept", "n_words", "row", "base", "taken", "size", "fp", "class")})
    model, quality_model = toxicity.fit(some, labels), quality.fit(some, labels)
    assert repetition.repetition_rules(none).count() == toxicity.scored(none, model).count() == toxicity.without_toxic(none, model).count() == quality.scored(none, quality_model).count() == 0
    assert decontaminate.contaminated(none, items).count() == decontaminate.contaminated(some, items).count() == decontaminate.decontaminated(none, items).count() == simhash.keep_one(none).count() == mixing.mixed(none).count() == 0
    assert rows(decontaminate.decontaminated(clash, items)) == rows(clash) and decontaminate.decontaminated(clash, items).columns == clash.columns
    assert dict(quality.scored(clash, quality_model).dtypes)["quality_score"] == "double"
    assert repetition.repetition_rules(clash).select("rules.n_words", "doc_id").orderBy("doc_id").collect() == [(27, 1), (0, 2)]
    assert substring.remove_repeats(clash).select("doc_id", "n_words").orderBy("doc_id").collect() == [(1, 27), (2, 0)]
    assert language_model.backoff_scores(clash).select("doc_id", "n_words").orderBy("doc_id").collect() == [(1, 27), (2, 0)]
    assert rows(toxicity.without_toxic(clash, model)) == rows(clash) and rows(simhash.keep_one(clash)) == rows(clash)
    assert mixing.mixed(clash).columns == clash.columns and sharding.sharded(clash).columns == [*clash.columns, "shard", "slot"]


def test_blocks_of_a_benchmark_give_one_result(spark, make):
    items = spark.createDataFrame([(k, prose(k, 12, 4000)) for k in range(6)], "item_id long, text string")
    docs = make([(i, f"{prose(i + 90, 9)} {prose(i % 9, 12, 4000)}") for i in range(30)])
    whole, parts = (rows(decontaminate.contaminated(docs, items, chars=n)) for n in (1 << 20, 60))
    assert whole == parts and whole
    assert rows(decontaminate.decontaminated(docs, items, chars=60)) == rows(decontaminate.decontaminated(docs, items))


def test_quality_calibrates_on_rows_kept_apart():
    y = np.array([0] * 20 + [1] * 40)
    apart = quality.Model._apart(y)
    assert len(apart) == 15 and set(y[apart]) == {0, 1}
    assert list(quality.Model._apart(np.array([0, 1, 1]))) == [0, 1, 2]


def test_toxic_sample_is_in_the_order_of_the_hash(spark, make):
    docs = make([(i, f"{'ab'[i % 2]} text {i}") for i in range(300)] + [(999, "x" * 900)])
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(300), 999]], "doc_id long, quality int, toxic int")
    open_ = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1)
    assert toxicity.sample(docs, labels, "toxic", 0, 40, 500) == [f"{'ab'[i % 2]} text {i}" for _, i in open_[:40]]


def test_toxic_spans_are_places_of_the_text():
    field = toxicity.Field({"w:vile": 20.0}, -8.0, np.zeros((2, 2)), np.zeros(2))
    ((_, spans),) = toxicity.Model(field, 1.0, 0.0).score(["İİ İstanbul vile VILE end"])
    assert [("İİ İstanbul vile VILE end")[s["start"] : s["end"]] for s in spans] == ["vile VILE"]


def test_cotraining_without_labels(spark, make):
    docs = make([(1, "a b"), (2, None)])
    none = labelled(spark, 0, int)
    assert {r["quality_score"] for r in quality.scored(docs, quality.fit(docs, none)).collect()} == {0.5}


# 6


def plain_targets(sizes, weights=(1, 2, 3), times=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    left, total, fixed = set(order), sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        goal = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if goal[s] >= times * sizes[s]]
        if not over:
            return fixed | goal
        for s in over:
            fixed[s] = times * sizes[s]
            left.discard(s)
        if not left:
            return fixed


def test_mix_meets_targets(make):
    r = random.Random(2)
    docs = [(i, prose(i, r.randint(0, 40)), r.choice(["a", "b", "b", "b", "b", "c", "d", None, "é"])) for i in range(400)] + [(900 + k, t, s) for k, (_, t, s) in enumerate(ODD)]
    out = mixing.mix(make(docs).withColumn("taken", F.lit("mine"))).toPandas()
    out["source"] = [None if s != s else s for s in out["source"]]
    size = Counter()
    for i, t, s in docs:
        size[s] += len(words(t))
    goals = plain_targets(size)
    for s in size:
        own = out[[x == s for x in out["source"]]]
        assert abs(own["target"].iloc[0] - goals[s]) < 1e-3 and own["taken"].sum() == int(own["target"].iloc[0] + 1e-9)
        assert (own["taken"] <= 3 * own["size"]).all()
    assert mixing.mix(make([])).count() == 0


def test_mixed_rows_hold_the_words_taken(make):
    docs = make([(i, prose(i, 5 + i % 30), "ab"[i % 5 == 0]) for i in range(200)])
    taken = {r[0]: r[1] for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken")).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert {r[0]: r[1] for r in out.groupBy("source").agg(F.sum(common.word_count(F.col("text")))).collect()} == taken


# 7


def test_marginals_against_all_paths():
    r = np.random.default_rng(0)
    e, starts = r.normal(0, 2, 11), np.zeros(11, bool)
    starts[[0, 5]] = True
    f = toxicity.Field({}, 0, np.array([[0.3, -0.4], [0.2, 0.9]]), np.array([0.1, -0.5]))
    p, moved = f.run(e, starts)
    z, q, m = 0.0, np.zeros(11), np.zeros((2, 2))
    for s in itertools.product((0, 1), repeat=11):
        weight = np.exp(sum(e[i] * s[i] + (f.first[s[i]] if starts[i] else f.move[s[i - 1], s[i]]) for i in range(11)))
        z, q = z + weight, q + weight * np.array(s)
        for i in np.flatnonzero(~starts):
            m[s[i - 1], s[i]] += weight
    assert np.allclose(p, q / z) and np.allclose(moved, m / z)


def test_toxicity_learns_words_and_stems(spark, make):
    bad = lambda i: i % 5 == 0

    def text(i):
        own = prose(i, 60, 3000).translate(str.maketrans("0123456789", "aeioubcdfg")).split()
        return " ".join(own[:30] + ([random.Random(i).choice(["vilest", "grimly" + own[3]])] if bad(i) else []) + own[30:])

    docs = [(i, text(i)) for i in range(600)] + [(1000 + k, d[1]) for k, d in enumerate(ODD)]
    df = make(docs)
    model = toxicity.fit(df, labelled(spark, 600, lambda i: int(bad(i))))
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.scored(df, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i]["score"] >= 0.7) == bad(i) for i in held) / len(held) > 0.95
    span = next(got[i]["spans"][0] for i in held if bad(i) and got[i]["spans"])
    assert any(docs[i][1][span["start"] : span["end"]].startswith(("vilest", "grimly")) for i in held)
    assert toxicity.without_toxic(df.withColumn("toxicity", F.lit(1)), model).columns == [*df.columns, "toxicity"]
    assert got[1000]["score"] < 0.7


def test_toxicity_without_labels(spark, make):
    df = make([(1, "a"), (2, None)])
    assert {r["toxicity"]["score"] for r in toxicity.scored(df, toxicity.fit(df, labelled(spark, 0, int))).collect()} == {0.0}


# 8


def plain_distance(p, t):
    prev = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        cur = [i]
        for j, b in enumerate(t, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (a != b)))
        prev = cur
    return min(prev), prev.index(min(prev))


def test_myers():
    r = random.Random(1)
    for _ in range(200):
        p, t = ("".join(r.choice("abc") for _ in range(r.randint(a, 90))) for a in (1, 0))
        assert decontaminate.myers(p, t) == plain_distance(p, t)


def test_contamination_against_all_distances(spark, make):
    r = random.Random(4)
    items = [(k, prose(50 + k, r.randint(6, 30), 5000)) for k in range(10)] + [(20, None), (21, ""), (0, prose(50, 8, 5000))]
    items[0] = items[-1]
    docs = []
    for i in range(60):
        t = list(r.choice(items[:10])[1])
        for _ in range(r.randint(0, len(t) // 10)):
            at = r.randrange(len(t))
            t[at : at + r.randint(0, 2)] = r.choice(["", "z", "zz"])
        docs.append((i, f"{prose(i, 20)} {''.join(t).upper()}\n {prose(i + 1, 9)}" if i % 4 else prose(i, 40)))
    got = decontaminate.contaminated(make(docs + [(100, None), (101, "")]), spark.createDataFrame(items, "item_id long, text string"))
    want = set()
    for (i, t), (k, q) in itertools.product(docs, items):
        if q and (d := plain_distance(decontaminate.normalise(q), decontaminate.normalise(t))[0]) <= int(0.05 * len(decontaminate.normalise(q))):
            want.add((i, k, d))
    assert {tuple(x)[:3] for x in got.collect()} == want and 20 < len(want)
    kept = decontaminate.decontaminated(make(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {x["doc_id"] for x in kept.collect()} == {i for i, _ in docs} - {w[0] for w in want}


# 9


def test_licenses(make):
    docs = [(1, "Code.\nReleased under the MIT License.\nMIT license, mit LICENSE"), (2, "All rights\nreserved."), (3, "reserved: ALL RIGHTS"), (4, "the mit\nlicense"), (5, "GNU General Public License version 3 of this work is licensed under the"), *((10 + k, d[1]) for k, d in enumerate(ODD))]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(make(docs).withColumn("license", F.lit(1))).collect()}
    assert tuple(got[1]) == (10, 3, 4, 8, "mit", "mit", 1.0)
    assert got[2]["labels"] == "all-rights-reserved" and got[3]["labels"] == "all-rights-reserved" and got[3]["base_labels"] == ""
    assert got[4]["labels"] == "mit" and got[4]["first_word"] == 1 and got[5]["labels"] == "gpl"
    assert tuple(got[10]) == (0, 0, None, None, "", "", 0.0)


def test_license_query_finds_wrapped_notices(spark, make, tmp_path):
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that"
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\r\n\r\nof this software and associated documentation files (the Software)"
    docs = [(1, f"A file.\n\n{bsd}\nend"), (2, mit), (3, "All rights\nreserved."), (4, "all\n" + "filler " * 30 + "rights reserved"), (5, None)]
    make(docs).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.op9_license_scan(spark, str(tmp_path)).collect()}
    assert got == {1: ("bsd", 1.0), 2: ("mit", 1.0), 3: ("all-rights-reserved", 1.0), 4: ("", 0.0), 5: ("", 0.0)}


def test_license_filters_lose_nothing():
    r = random.Random(9)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in licenses.tokens(t.encode())})
    for threshold in (0.5, 0.7, 0.9):
        index = licenses.Index(licenses.TEMPLATES, {w: r.randrange(5) for w in vocabulary}, threshold)
        for _ in range(200):
            base = licenses.tokens(r.choice(licenses.TEMPLATES)[1].encode())
            body = r.choices(vocabulary, k=r.randint(0, 30)) + base[: r.randint(1, len(base))] + r.choices([*vocabulary, b"filler"], k=r.randint(0, 30))
            windows = [set(body[a : a + index.window]) for a in range(max(1, len(body) - index.window + 1))]
            plain = [(label, set(licenses.tokens(t.encode()))) for label, t in licenses.TEMPLATES]
            most = [(label, max(len(own & x) for x in windows), len(own)) for label, own in plain]
            assert sorted(index.find(body)) == sorted((label, both / size) for label, both, size in most if both >= licenses.needed(size, threshold))
        assert all(index.turned_away[f] > 0 for f in ("length", "position", "counted"))


def test_licenses_of_an_empty_table(make):
    assert licenses.scan(make([])).count() == 0


# 10


def every_gram_backoff(docs, order=3):
    """Scores against the counts of all n-grams, those that stand once included."""
    toks = [words((t or "").lower()) for _, t in docs]
    grams = Counter(tuple(x[i : i + k]) for x in toks for k in range(1, order + 1) for i in range(len(x) - k + 1))
    n, out = sum(map(len, toks)), []
    for (i, _), x in zip(docs, toks):
        levels, total = [0] * order, 0.0
        for j in range(len(x)):
            # The whole corpus is counted, so the longest n-gram that ends here has a count.
            k = min(j + 1, order)
            g = tuple(x[j - k + 1 : j + 1])
            total += np.log10(grams[g] / (grams[g[:-1]] if k > 1 else n))
            levels[k - 1] += 1
        out.append((i, len(x), levels, round(float(total), 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("heavy", [False, True])
def test_backoff_against_dictionaries(make, monkeypatch, order, heavy):
    if heavy:  # nearly every key takes the route of frequent ones
        monkeypatch.setattr(language_model, "HEAVY", 300)
        monkeypatch.setattr(language_model, "LEAST_HEAVY", 2)
        monkeypatch.setattr(language_model, "SAMPLED", 1)
    docs = [(i, prose(i % 40, 50, 30 if i % 2 else 4)) for i in range(60)] + [(i, t) for i, t, _ in ODD]
    assert not heavy or all(map(len, language_model.frequent(make(docs), order)))
    got = language_model.backoff_scores(make(docs), order=order)
    assert rows(got.select("doc_id", "n_words", "n_by_order", F.round("log10_prob", 6))) == every_gram_backoff(docs, order)


def test_backoff_of_an_empty_table(make):
    assert language_model.backoff_scores(make([])).count() == 0


def test_backoff_query_prunes_nothing(spark, make, tmp_path):
    docs = [(1, "a b c a b d"), (2, "a b c e"), (3, "solo words once")]
    make(docs).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in language_model.op10_stupid_backoff(spark, str(tmp_path)).collect()}
    for i, n, levels, total in every_gram_backoff(docs):
        assert (got[i]["n_words"], [got[i][f"n_order{k}"] for k in (1, 2, 3)], got[i]["log10_prob"]) == (n, levels, round(total, 4))
