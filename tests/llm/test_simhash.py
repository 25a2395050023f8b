"""SimHash and near-duplicate groups against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vecspark.llm import graph, near_dedup, simhash
from vecspark.llm.graph import connected_components
from vecspark.llm.shared import written


def plain_print(text, k=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, near):
    left, out = set(values), {}
    while left:
        queue = [left.pop()]
        group = set(queue)
        while queue:
            x = queue.pop()
            found = {y for y in left if near(x, y)}
            left -= found
            group |= found
            queue += found
        out |= {x: min(group) for x in group}
    return out


def test_prints_and_classes(documents, sentences):
    rng = random.Random(2)
    base = sentences("en", 300).split()
    texts = [None, "", " \t", "One", "one", "a b", "A  B", "x y z", " ".join(base), " ".join(base).upper()]
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(300)] = "other"
        texts.append(" ".join(copy))
    texts += [sentences("en", 40) for _ in range(40)]
    want = [plain_print(t) for t in texts]
    least = components(list(enumerate(want)), lambda a, b: (a[1] ^ b[1]).bit_count() <= 3)
    got = simhash.near_duplicate_classes(documents(texts)).withColumn("hex", simhash.hex_digits("fingerprint")).collect()
    assert len(got) == len(texts)
    for r in got:
        k = r["doc_id"]
        assert r["hex"] == f"{want[k]:016x}", texts[k]
        assert r["component_id"] == least[k, want[k]][0]


def test_masks_cover_every_pair_in_the_radius():
    rng = random.Random(1)
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius, list(range(64)), 5)
        for _ in range(500):
            differ = sum(1 << p for p in rng.sample(range(64), radius))
            assert any(not differ & m for m in masks)


def test_links_of_large_buckets(spark):
    rng = np.random.default_rng(0)
    centre = int(rng.integers(1 << 62))
    values = {centre}
    for _ in range(700):  # all within a few bits of one another
        values.add(centre ^ sum(1 << int(p) for p in rng.choice(64, int(rng.integers(1, 6)), replace=False)))
    values |= {int(x) for x in rng.integers(1 << 62, size=200)}
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fingerprint long")
    for bucket in (4, 100, 10_000):
        labels = {r["node"] & (1 << 64) - 1: r["label"] for r in connected_components(simhash.near_links(df, 3, bucket)).collect()}
        want = components(values, lambda a, b: (a ^ b).bit_count() <= 3)
        sizes = {}
        for v in values:
            sizes.setdefault(want[v], []).append(v)
        for group in sizes.values():
            assert len({labels.get(v, v) for v in group}) == 1
        assert len({labels.get(v, ("alone", v)) for v in values}) == len(sizes)


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[k] for k in range(61)}) == 1 and len({got[k] for k in range(1000, 1100)}) == 1 and len(set(got.values())) == 3
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_strange_rows(strange, empty):
    got = simhash.near_duplicate_classes(strange).collect()
    assert len(got) == 6 and {r["component_id"] for r in got if r["doc_id"] in (2, 3)} == {2}
    assert simhash.near_duplicate_classes(empty).count() == 0
    kept = near_dedup.keep_one(strange)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4] and kept.columns == strange.columns
    assert near_dedup.keep_one(empty).count() == 0


def test_one_of_each_group_of_near_copies_stays(documents, sentences):
    rng = random.Random(7)
    texts, groups = [], []
    passage = sentences("en", 60)
    for g in range(12):
        base = (sentences("en", 200) + " " + passage).split()
        for c in range(1 + g % 6 * 3):
            copy = list(base)
            for _ in range(2 if c else 0):  # two words of 260: a similarity of 0.92
                copy[rng.randrange(len(copy))] = sentences("en", 1)
            texts.append(" ".join(copy))
            groups.append(g)
    kept = sorted(r["doc_id"] for r in near_dedup.keep_one(documents(texts)).select("doc_id").collect())
    assert [groups[k] for k in kept] == sorted(set(groups))
    assert all(k == groups.index(groups[k]) for k in kept)


def test_links_can_be_read_again(documents, sentences):
    df = documents([sentences("de", 30) for _ in range(5)] * 2)
    assert near_dedup.keep_one(df).count() == 5
    assert simhash.near_duplicate_classes(df).agg(F.countDistinct("component_id")).first()[0] == 5


def shingle_set(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def smallest_of_groups(texts):
    """The first of each group that similarities of at least 0.8 join."""
    sets = [shingle_set(t) for t in texts]
    label = components(range(len(texts)), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    return sorted(set(label.values()))


def test_links_are_decided_by_the_exact_similarity(documents, sentences):
    rng = random.Random(11)
    texts = []
    for g in range(60):  # some pairs a little over 0.8, some a little under
        base = [f"{w}{rng.randrange(1000)}" for w in sentences("en", 204).split()]
        copy = list(base)
        for j in range(4 if g % 2 else 6):  # five shingles of 200 each
            copy[10 + 30 * j] = f"changed{g}x{j}"
        texts += [" ".join(base), " ".join(copy)]
    line = "one line that is there again and again in all of these texts"
    texts += [" ".join([line] * 60 + [f"{w}{rng.randrange(10**6)}" for w in sentences("de", 60).split()]) for _ in range(6)]
    kept = sorted(r["doc_id"] for r in near_dedup.keep_one(documents(texts)).select("doc_id").collect())
    assert kept == smallest_of_groups(texts) and len(kept) == 60 + 30 + 6


@pytest.mark.parametrize(("block", "sample"), [(2048, 1024), (8, 1024), (8, 64)])
def test_near_pairs_in_a_group_that_shares_a_passage(documents, sentences, monkeypatch, block, sample):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "SAMPLE", sample)
    monkeypatch.setattr(near_dedup, "SLACK", 0.08 if sample == 1024 else 0.4)
    rng = random.Random(13)
    passage = [f"{w}{rng.randrange(1000)}" for w in sentences("fr", 300).split()]
    texts = []
    for g in range(40):  # pairs are a little over 0.8, others near 0.7: mostly one passage
        own = [f"own{g}x{k}" for k in range(60)]
        copy = passage + own
        for j in range(7):
            copy[4 + 40 * j] = f"changed{g}x{j}"
        texts += [" ".join(passage + own), " ".join(copy)]
    kept = sorted(r["doc_id"] for r in near_dedup.keep_one(documents(texts), views=6, sample=1).select("doc_id").collect())
    assert kept == smallest_of_groups(texts) and len(kept) == 40


def test_alike_texts_below_the_similarity_give_no_rows(spark, documents, sentences, monkeypatch):
    rng = random.Random(3)
    base = [f"{w}{rng.randrange(1000)}" for w in sentences("en", 40).split()]
    texts = []
    for k in range(120):
        copy = list(base)
        for j in rng.sample(range(5, 35), 2):
            copy[j] = f"own{k}x{j}"
        texts.append(" ".join(copy))
    seen = []
    monkeypatch.setattr(near_dedup, "written", lambda df, name: seen.append((name, out := written(df, name))) or out)
    kept = sorted(r["doc_id"] for r in near_dedup.keep_one(documents(texts)).select("doc_id").collect())
    assert kept == smallest_of_groups(texts)
    rows = {name: df.count() for name, df in seen}
    assert rows["unsettled-links"] <= len(texts) and rows["near-pairs"] <= 16 * len(texts)


@pytest.mark.parametrize("tail", [0, 40, 10_000])
def test_components_however_many_links_are_left(spark, monkeypatch, tail):
    monkeypatch.setattr(graph, "TAIL", tail)
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 6000 + k) for k in range(40)] + [(7, 7)]
    group = {x: x for link in links for x in link}
    for a, b in links:
        old, new = group[a], group[b]
        group = {x: new if g == old else g for x, g in group.items()}
    got = {r["node"]: r["label"] for r in graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    alone = {x for x in group if sum(g == group[x] for g in group.values()) == 1}
    assert set(got) == set(group) - alone
    assert len(set(got.values())) == len({group[x] for x in got}) == len({(group[x], l) for x, l in got.items()})
