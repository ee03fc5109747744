"""Sharding, mixing, dedup, classifiers and rules on small tables with hard cases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strikelake.llm import exact, langid, mixing, quality, rules, setsketch, sharding, toxicity
from strikelake.llm.components import components
from strikelake.llm.shared import prefix_sums

DOCS = "doc_id long, text string, lang string, source string"


def hard(spark):
    """Null and repeated ids, null and empty texts, repeated rows, columns that clash."""
    rows = [(i, f"text {i % 7}", "en", "a" if i % 3 else None, 9) for i in range(60)]
    rows += [(None, None, None, None, 1), (None, None, None, None, 1), (3, "", "en", "b", 2), (3, "", "en", "b", 2)]
    return spark.createDataFrame(rows, DOCS + ", shard long")


@pytest.mark.parametrize("n_shards,bucket_bytes", [(24, 1 << 20), (5, 200), (1, 64), (200, 100)])
def test_shards(spark, n_shards, bucket_bytes):
    docs = hard(spark)
    rows = sharding.shuffle_shards(docs, n_shards, bucket_bytes=bucket_bytes).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in rows) == Counter(
        (r.doc_id, r.text, r.source) for r in docs.collect()
    )
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(slots.get(s, [])) for s in range(n_shards)]
    assert sum(sizes) == 64 and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_shuffled_written_and_empty(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    out = sharding.shuffle_shards(docs, 4, bucket_bytes=2000)
    sharding.write_shards(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards")).collect()
    order = [r.doc_id for r in sorted(back, key=lambda r: (r.shard, r.slot))]
    assert sorted(order) == list(range(400))
    assert abs(np.corrcoef(order, range(400))[0, 1]) < 0.2
    assert sharding.shuffle_shards(docs.limit(0), 4).count() == 0
    with pytest.raises(ValueError):
        sharding.shuffle_shards(docs, 0)


def test_prefix_sums_cross_groups(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(50)], "i long, v long")
    got = {r.i: r.s for r in prefix_sums(df, "i", "v", "s", group=7).collect()}
    assert got == {i: sum(j % 5 for j in range(i)) for i in range(50)}


def schedule(quotas: list[int], period: int) -> list[int]:
    done, out = [0] * len(quotas), []
    for t in range(period):
        free = [i for i, q in enumerate(quotas) if done[i] * period // q <= t]
        best = min(free, key=lambda i: (-(-(done[i] + 1) * period // quotas[i]), i))
        done[best] += 1
        out.append(best)
    return out


@pytest.mark.parametrize("weights", [None, [("a", 5.0), ("b", 1.0), (None, 2.0), ("gone", 9.0)], [("a", 0.0)]])
def test_mixing_keeps_every_source_within_a_block(spark, weights):
    rows = [(i, f"t{i}", "en", ("a", "b", None)[0 if i % 4 < 2 else i % 4 - 1]) for i in range(400)]
    docs = spark.createDataFrame(rows + rows[:3], DOCS)
    table = weights and spark.createDataFrame(weights, "source string, weight double")
    out = mixing.mix(docs, table, block_rows=5, period=40).collect()
    assert sorted(r.position for r in out) == list(range(403))
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows + rows[:3])
    share = {r.source: r.quota for r in out}
    assert sum(share.values()) == 40 and min(share.values()) >= 1
    names = sorted(share, key=lambda s: (s is not None, s or ""))
    turn = schedule([share[s] for s in names], 40)
    slot_of = {}
    for r in out:
        slot_of.setdefault(r.mix_slot, (r.source, r.block))
        assert slot_of[r.mix_slot] == (r.source, r.block)
        assert names[turn[r.mix_slot % 40]] == r.source
    blocks = Counter(s for s, _ in slot_of.values())
    ends = min(max(t for t, (s, _) in slot_of.items() if s == name) for name in names)
    for t in range(1, ends + 1):
        taken = Counter(names[turn[x % 40]] for x in range(t))
        assert all(abs(taken[s] - t * share[s] / 40) < 1 for s in names)
    assert sum(blocks.values()) == len(slot_of)
    order = [r.mix_slot for r in sorted(out, key=lambda r: r.position)]
    assert order == sorted(order)


@pytest.mark.parametrize("extra", [0, 300])
def test_mixing_of_more_sources_than_a_period_has_slots(spark, extra):
    rows = [(i, f"t{i}", "en", f"s{i % 61}") for i in range(61 * 9)] + [(-1 - i, "x", "en", "big") for i in range(extra)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS), block_rows=2, period=40).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    order = sorted(out, key=lambda r: r.position)
    assert [r.position for r in order] == list(range(len(rows)))
    assert [r.mix_slot for r in order] == sorted(r.mix_slot for r in out)
    slots = {r.mix_slot: (r.source, r.block) for r in out}
    assert len(slots) == len({(r.source, r.block) for r in out})
    small = next(r.quota for r in out if r.source != "big")
    share = {r.source: r.quota / 40 / (1 if r.source == "big" else 61) for r in out}
    assert abs(sum(share.values()) - 1) < 1e-9 and (not extra or 1 <= small < 40)
    ends = min(max(t for t, (s, _) in slots.items() if s == name) for name in share)
    done = Counter()
    for t in range(ends + 1):
        done[slots[t][0]] += 1
        assert all(abs(done[s] - (t + 1) * share[s]) < 1 for s in share)


def test_mixing_of_nothing_and_of_hard_rows(spark):
    docs = hard(spark)
    assert mixing.mix(docs.limit(0)).count() == 0
    out = mixing.mix(docs, block_rows=4)
    assert sorted(r.position for r in out.collect()) == list(range(64))
    assert mixing.in_order(out).select("position").collect()[0].position == 0


def plain_copies(rows):
    text = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[text(t)].append(i)
    return {(i, min((x for x in groups[text(t)] if x is not None), default=None), len(groups[text(t)]))
            for i, t in rows}


def test_exact_copies(spark):
    long = "word " * 30_000
    texts = [None, "", " ", "a  b", "a\tb", "a b", "a b ", long, long + "x", long + "y", long, "x" * 64, "x" * 65]
    rows = list(enumerate(texts)) + [(None, "a b"), (None, "only"), (3, "a b"), (3, "a b"), (20, "x" * 64)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, _row long")
    out = exact.mark_copies(docs).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in out} == plain_copies(rows)
    groups = defaultdict(list)
    for r in out:
        groups[r.text_sha256].append(r)
    assert all(sum(r.kept for r in g) == 1 and len(g) == g[0].group_size for g in groups.values())
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact.mark_copies(docs.limit(0)).count() == 0


def plain_components(texts: dict, k: int):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[d] = {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_texts(n_hot: int) -> dict:
    draw = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    base = draw.choices(words, k=120)
    texts = {0: None, 1: "", 2: "  ", 3: "one two", 4: "One TWO", 5: "one", 6: "É x y z", 7: "é x y z"}
    for i in range(n_hot):  # many near copies of one text, each with its own edits
        copy = list(base)
        for _ in range(draw.randint(0, 4)):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        texts[100 + i] = " ".join(copy)
    chain = draw.choices(words, k=80)
    for i in range(12):  # each links to its neighbours only
        texts[50 + i] = " ".join(chain[i * 4 :] + draw.choices(words, k=i * 4))
        texts[70 + i] = " ".join(draw.choices(words, k=60) + base[:30])
        chain = (chain[: i * 4] + texts[50 + i].split())[: len(chain) + i * 4]
    return texts


@pytest.mark.parametrize("k", [4, 5])
def test_near_groups_against_all_pairs(spark, k):
    texts = near_texts(60)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: r for r in setsketch.near_groups(docs, words=k).collect()}
    want = plain_components(texts, k)
    assert {d: (r.n_shingles, r.component_id) for d, r in out.items()} == want
    assert all(r.kept == (d == r.component_id) for d, r in out.items())


def test_near_dedup_of_repeated_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "A b c d e f"), (2, None), (2, None), (None, "z")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _row long")
    left = setsketch.drop_near(docs)
    assert left.columns == docs.columns
    assert sorted(left.select("doc_id", "text").collect(), key=str) == sorted(
        [(5, "a b c d e f"), (2, None), (2, None), (None, "z")], key=str
    )
    assert setsketch.near_groups(docs.limit(0)).count() == 0


def test_sketch_estimates_similarity_and_merges():
    draw = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8, 0.95):
        both = draw.integers(0, 1 << 63, int(4000 * share)).astype(np.uint64)
        own = [draw.integers(0, 1 << 63, int(4000 * (1 - share) / 2)).astype(np.uint64) for _ in range(2)]
        sets = [np.unique(np.concatenate([both, o])) for o in own]
        a, b, union = setsketch.registers([*sets, np.unique(np.concatenate(sets))])
        assert (np.maximum(a, b) == union).all()
        n = [np.array([len(s)], float) for s in sets]
        assert abs(setsketch.estimate(a[None], b[None], *n)[0] - share) < 0.12


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    df = spark.createDataFrame(links, "u long, v long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {i: 0 for i in range(1, 21)} | {100 + i: 100 for i in range(1, 30)}
    assert components(df.limit(0)).count() == 0


def test_language_codes():
    for n in (2, 4, 7, 20):
        code = langid.codewords(n)
        assert len({tuple(c) for c in code}) == n
        assert all(set(bit) == {-1, 1} for bit in code.T)
    assert langid.codewords(1).shape == (1, 1)


def test_language_of_hard_rows(spark):
    learned = [(i, "der und die das ist nicht", "de", None) for i in range(5)]
    learned += [(i, "the and of this is not", "en", None) for i in range(5)] + [(9, "junk", None, None)]
    codes = langid.learn(spark.createDataFrame(learned, DOCS))
    texts = [None, "", "12 %", "und das ist", "this is the", "é"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score long")
    out = [r for r in langid.identify(docs, codes).orderBy("doc_id").collect()]
    assert [r.lang_pred for r in out][:5] == ["und", "und", "und", "de", "en"] and out[5].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in out)
    none = langid.learn(docs.select("text", F.lit(None).cast("string").alias("lang")))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.limit(0), codes).count() == 0


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_on_hard_rows(spark, module):
    docs = spark.createDataFrame([(i, ("bad###" if i % 2 else "good") + f" w{i}", 7) for i in range(80)]
                                 + [(None, "x", 7), (81, None, 7), (82, "", 7)], "doc_id long, text string, score long")
    name = "toxic" if module is toxicity else "quality"
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (81, 1), (82, None), (3, 1)],
                                   f"doc_id long, {name} int")
    model = module.learn(docs, labels)
    out = {r.doc_id: r.score for r in module.score(docs, model).collect()}
    assert len(out) == 83 and all(0 <= s <= 1 for s in out.values())
    assert np.mean([(out[i] >= 0.5) == i % 2 for i in range(80)]) > 0.9
    blank = module.learn(docs, labels.limit(0))
    assert all(r.score == 0.5 for r in module.score(docs.select("text"), blank).collect())
    assert module.score(docs.limit(0), model).count() == 0


def test_sample_is_bounded(spark):
    from strikelake.llm.sample import labelled, remainder

    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") < 10).cast("int").alias("y"))
    got = labelled(docs, labels, "y", rows=30, max_bytes=10, by_class=True)
    assert Counter(y for _, y in got) == {0: 15, 1: 10}
    assert labelled(docs, labels, "y", rows=30, max_bytes=10, by_class=False).__len__() == 30
    assert labelled(docs, labels, "y", rows=30, max_bytes=1, by_class=False) == []
    import zlib

    crc = docs.select("doc_id", remainder("doc_id", 5).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.doc_id).encode()) % 5 for r in crc)


def test_rules_keep_the_usual_and_reject_the_odd(spark):
    draw = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"] + [f"w{i}x" for i in range(300)]
    rows = [(i, " ".join(draw.choices(words, k=draw.randint(60, 300))), "en", "a" if i % 3 else None) for i in range(200)]
    rows += [(900, " ".join(w + "###" for w in draw.choices(words, k=100)), "en", "a")]
    rows += [(901, "few words", "en", "a"), (902, None, None, None), (903, "again and again " * 40, "en", "a"), (904, "", "en", "a")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], DOCS + ", n_words long")
    out = {r.doc_id: r for r in rules.judge(docs).collect()}
    assert len(out) == len(rows)
    assert [d for d, r in out.items() if not r.kept] == [d for d in out if d >= 900]
    assert {d for d, r in out.items() if r.base_failed} == {901, 902, 903, 904}
    assert rules.judge(docs.limit(0)).count() == 0
    assert rules.judge(docs.filter("doc_id = 901")).first().kept is False


@pytest.mark.parametrize("share", [0.5, 0.7, 0.95])
def test_rules_reject_repeated_lines_in_a_clean_group(spark, share):
    draw = random.Random(3)
    word = lambda: "".join(draw.choices("abcdefghij", k=draw.randint(4, 6)))
    line = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, "\n".join(line(10) for _ in range(draw.randint(6, 25))), "en", "a") for i in range(120)]
    for i in range(5):  # 20 lines of one word, most of them alike, among 120 other words
        same, again = word(), round(share * 21) + 1
        short = [same] * again + [word() for _ in range(20 - again)]
        rows.append((900 + i, "\n".join([line(120), *short]), "en", "a"))
    out = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert not any(r.base_failed for r in out.values())
    assert all(out[900 + i].n_dup_lines >= share * 20 - 1 for i in range(5))
    assert [d for d, r in sorted(out.items()) if not r.kept] == [900, 901, 902, 903, 904]
