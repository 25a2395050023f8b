"""URL rules, language, toxicity, decontamination and the pipeline."""

import glob
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from vecspark.llm import decontaminate, langid, queries, toxicity, url_filter

PAGES = "page_id long, url string, html string"


def test_hosts_paths_and_rules(spark):
    urls = [
        ("http://a.com/x?y#z", "a.com", "/x", "com/", "allow"),
        ("https://WWW.Example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("https://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
        ("https://example.com/EN/1", "example.com", "/EN/1", "com/", "allow"),
        ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("x://b.net/fr/", "b.net", "/fr/", "net/fr/", "block"),
        ("x://b.net/de/://c.com/", "b.net", "/de/://c.com/", None, None),
        ("http://a.com", "a.com", "", None, "allow"),
        ("http://a.com?q=/x", "a.com", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        ("h\ttp://É.COM/\n/x", "É.com".replace("com", "com"), "/\n/x", "com/", "allow"),
    ]
    df = spark.createDataFrame([(k, u[0], None) for k, u in enumerate(urls)], PAGES)
    for r in url_filter.judge(df, queries.RULES).collect():
        _, host, path, rule, verdict = urls[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), urls[r["page_id"]]
        if verdict:
            assert r["verdict"] == verdict


def test_trust_and_distrust_run_along_links(spark):
    link = lambda *to: "".join(f'<a HREF = "{t}">x</a>' for t in to)
    pages = [
        (1, "http://good.com/", link("http://friend.org/a", "//friend.org/b", "/own")),
        (2, "http://friend.org/", ""),
        (3, "http://bad.net/es/", None),
        (4, "http://farm.org/", link("https://bad.net/es/")),
        (5, "http://farm.org/2", link("https://bad.net/fr/")),
        (6, "http://outer.org/", link("http://nobody.org/")),
    ]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(pages, PAGES), queries.RULES, threshold=0.3).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow"}
    con = duckdb.connect()
    con.register("pages", spark.createDataFrame(pages, PAGES).toPandas())
    want = {r[0]: r[4] for r in con.sql(url_filter.sql(queries.RULES, threshold=0.3)).fetchall()}
    assert want == got
    assert url_filter.judge(spark.createDataFrame([], PAGES), queries.RULES).count() == 0


def test_a_large_graph_against_plain_rounds(spark):
    rng = random.Random(8)
    hosts = ["hub.org"] + [f"h{k}.{rng.choice(['com', 'net', 'org', 'info'])}" for k in range(1500)]
    links, pages = {h: set() for h in hosts}, []
    for k, h in enumerate(hosts):
        if k % 5 == 4:
            continue  # links nowhere
        links[h] = {rng.choice(hosts) for _ in range(rng.randint(1, 6))} | ({"hub.org"} if k % 2 else set())
        if h == "hub.org":
            links[h] = set(rng.sample(hosts, 700))
        links[h] -= {h}
    for k, h in enumerate(hosts):
        for c in range(1 + k % 3):
            path = "/fr/x" if h.endswith(".net") and k % 4 == 0 else "/y"
            pages.append((len(pages), f"http://{h}{path}", "".join(f'<a href="https://{t}/">' for t in sorted(links[h]))))
    mass = {"trust": Counter(), "distrust": Counter()}
    for _, url, _ in pages:
        h = url.split("/")[2]
        if h.endswith(".com"):
            mass["trust"][h] += 1
        elif h.endswith(".net") and "/fr/" in url:
            mass["distrust"][h] += 1
    back = {h: [g for g in hosts if h in links[g]] for h in hosts}
    for kind, to in (("trust", links), ("distrust", back)):
        seeds = now = dict(mass[kind])
        for _ in range(10):
            moved = Counter(seeds)
            for h, m in now.items():
                for t in to[h]:
                    moved[t] += 0.85 * m / len(to[h])
            now = dict(moved)
        mass[kind] = Counter(now)
    count = Counter(u.split("/")[2] for _, u, _ in pages)
    blocked = {h for h in hosts if mass["distrust"][h] - mass["trust"][h] > 0.5 * count[h] + 1e-9}
    rules = [("com", "/", "allow"), ("net", "/fr/", "block")]
    df = spark.createDataFrame(pages, PAGES).repartition(4)
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, rules).collect()}
    want = {i: "allow" if u.split("/")[2].endswith(".com") else "block" if ".net/fr/" in u or u.split("/")[2] in blocked else "allow" for i, u, _ in pages}
    assert got == want and 20 < len(blocked) < 1000


def test_repeated_pages_and_names_that_clash(spark):
    page = ("http://b.net/fr/" + "x" * 100_000, "<a href='//c.org/'>")
    df = spark.createDataFrame([(1, *page), (1, *page), (None, "http://c.org/", "")], PAGES).withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "verdict", "kind", "mass", "k", "pages", "next")})
    got = url_filter.judge(df, queries.RULES).collect()
    assert sorted((r["page_id"] or 0, r["rule"], r["verdict"]) for r in got if r["page_id"]) == [(1, "net/fr/", "block")] * 2 and len(got) == 3


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the tables aren't here")
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    mine, theirs = queries.queries()[name](spark, folder), con.sql(queries.oracle_sql()[name])
    columns = sorted(mine.columns)
    order = [theirs.columns.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in mine.collect()) == sorted(str(tuple(r[i] for i in order)) for r in theirs.fetchall())


def test_language(documents, sentences, strange, empty):
    langs = [lang for lang in langid.LANGUAGES for _ in range(30)]
    texts = [sentences(lang, 40) for lang in langs]
    given = list(langs)
    given[0] = "fr"  # a wrong declaration
    given[1] = None
    given[2] = "xx"
    got = {r["doc_id"]: r for r in langid.identify(documents(texts, langs=given)).collect()}
    assert [got[k]["lang_pred"] for k in range(len(langs))] == langs
    assert all(got[k]["keep"] for k in range(len(langs)))
    assert len(langid.identify(strange).collect()) == 6 and langid.identify(empty).count() == 0
    kept = langid.keep_identified(strange)
    assert kept.columns == strange.columns
    # without text the host and the declaration decide
    more = documents([*texts, None, "123 !!"], langs=[*langs, "de", "es"])
    last = {r["doc_id"]: r for r in langid.identify(more).collect()}
    assert (last[len(langs)]["lang_pred"], last[len(langs) + 1]["lang_pred"], last[len(langs)]["text_lang"]) == ("de", "es", None)


def test_language_of_suffix_and_host(spark):
    rows = [(k, "", None, f"h{k % 2}.example.{'de' if k % 2 else 'fr'}", "de" if k % 2 else "fr") for k in range(40)] + [(100, "", None, "new.example.de", None), (101, "", "es-ES", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string, tld string").withColumn("lang", F.coalesce("lang", F.when(F.col("doc_id") < 40, F.col("tld"))))
    got = {r["doc_id"]: r for r in langid.identify(df, suffix="tld", host="host").collect()}
    assert got[1]["lang_pred"] == "de" and got[0]["lang_pred"] == "fr"
    assert got[100]["lang_pred"] == "de"  # by its domain
    assert got[101]["lang_pred"] == "es"


def test_language_rejects_other_texts_and_contradictions(documents, sentences):
    langs = [lang for lang in langid.LANGUAGES for _ in range(30)]
    texts = [sentences(lang, 40) for lang in langs]
    junk = ["Это русский текст для проверки, он длинный", "x8Kq zPv3 Lm9w QRtY uWz7 bbXq kJh5 vvGz", "我们今天去公园散步然后回家吃饭"]
    docs = documents([*texts, *junk], langs=[*langs, None, "xx", "ru"])
    got = {r["doc_id"]: r["keep"] for r in langid.identify(docs).collect()}
    assert [got[k] for k in range(len(got))] == [True] * len(langs) + [False] * len(junk)
    assert sorted(r["doc_id"] for r in langid.keep_identified(docs).collect()) == list(range(len(langs)))
    # two trigrams for Spanish, 4.6 in all, are outvoted by the host and the declaration
    counts = np.full((1, 4, 1 << langid.BUCKET_BITS), 0.0)
    counts[0, :, 0] = 5000
    for gram in langid.trigrams(b"ab"):
        counts[0, :, gram] = 10
        counts[0, langid.LANGUAGES.index("es"), gram] = 100
    rows = documents(["ab", *[None] * 300], langs=["de"] * 301).withColumn("source", F.lit("one"))
    found = {r["doc_id"]: r for r in langid.identify(rows, model=langid.TextModel(counts, 60.0)).collect()}
    assert (found[0]["lang_pred"], found[0]["text_lang"], found[0]["keep"], found[1]["keep"]) == ("de", "es", False, True)
    assert found[0]["confidence"] >= 0.5


def test_language_of_pages(spark, tmp_path, sentences):
    rows, want = [], {}
    for k in range(120):
        lang = langid.LANGUAGES[k % 4]
        said = "" if k % 10 == 0 else f' lang="{lang}-X"'
        rows.append((k, f"https://{'m.' if k % 3 else ''}site{k % 4}.example.{lang}/p?q={k}", f"<!DOCTYPE html><HTML class='a'{said}><head><style>p {{the: th}}</style><title>T</title></head><body><p>{sentences(lang, 40)}</p></body></html>"))
        want[k] = lang
    rows += [(200, "https://new.site1.example.en/", None), (201, None, '<html lang="es">')]
    spark.createDataFrame(rows, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in queries.op4_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == 122 and {k: got[k]["lang_pred"] for k in want} == want
    assert got[200]["lang_pred"] == "en"  # by suffix and the host's domains
    assert got[201]["lang_pred"] == "es"  # by markup


def plain_languages(rows, right=0.9, suffix_right=0.7, smoothing=20.0, weight=60.0):
    """The whole fusion, row by row, for rows (id, fold, text, declared, suffix, host)."""
    langs = langid.LANGUAGES
    counts = {(f, l): Counter() for f in range(langid.FOLDS) for l in langs}
    for _, fold, text, declared, _, _ in rows:
        if declared in langs and text is not None:
            counts[fold, declared].update(langid.trigrams(text.encode()).tolist())
    domains = lambda h: [".".join(h.split(".")[-n:]) for n in range(1, h.count(".") + 2)] if h else []
    said = Counter()
    for _, fold, _, declared, _, host in rows:
        for d in ["*", *domains((host or "").lower())]:
            for l in langs if declared in langs else ():
                said[fold, d, l] += right if l == declared else (1 - right) / 3
    out = {}
    for i, fold, text, declared, suffix, host in rows:
        grams = langid.trigrams((text or "").encode()).tolist()
        other = [f for f in range(langid.FOLDS) if f != fold]
        logs = {}
        for l in langs:
            c = sum((counts[f, l] for f in other), Counter())
            total = sum(c.values()) + 0.1 * 65536
            logs[l] = sum(math.log((c[g] + 0.1) / total) for g in grams) * min(1.0, weight / max(1, len(grams)))
        text_logs = dict(logs)
        p = {l: sum(said[f, "*", l] for f in other) + 1 for l in langs}
        p = {l: x / sum(p.values()) for l, x in p.items()}
        for d in domains((host or "").lower()):
            p = {l: sum(said[f, d, l] for f in other) + smoothing * p[l] for l in langs}
            p = {l: x / sum(p.values()) for l, x in p.items()}
        for l in langs:
            logs[l] += math.log(p[l]) if host else math.log(0.25)
            for given, chance in ((declared, right), (suffix, suffix_right)):
                if given in langs:
                    logs[l] += math.log(chance if given == l else (1 - chance) / 3)
        top = max(logs.values())
        best = max(langs, key=lambda l: (logs[l], -langs.index(l)))
        chance = 1 / sum(math.exp(x - top) for x in logs.values())
        enough = sum(sum(counts[f, l].values()) for f in other for l in langs) >= 10_000
        none = (1 - math.log(65536)) * min(len(grams), weight) - max(text_logs.values()) if grams and enough else -math.inf
        keep = chance >= 0.5 and max(max(text_logs.values()) - text_logs[best], none if grams else 0) <= 3.0
        out[i] = (best, chance, keep)
    return out


def test_the_whole_fusion_by_brute_force(spark, sentences):
    rng = random.Random(9)
    rows = []
    for k in range(160):
        lang = langid.LANGUAGES[k % 4]
        text = None if k % 17 == 0 else sentences(lang, rng.choice([1, 2, 40]))
        declared = rng.choice([lang, lang, lang, "de", None, "xx"])
        host = None if k % 13 == 0 else f"{rng.choice(['a', 'b'])}.{rng.choice(['One', 'two'])}.{rng.choice([lang, 'org'])}"
        rows.append((k, text, declared, host and host.split(".")[-1], host))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, tld string, host string")
    folds = {r["doc_id"]: r["f"] for r in df.select("doc_id", langid.fold_of(F.col("doc_id")).alias("f")).collect()}
    want = plain_languages([(r[0], folds[r[0]], *r[1:]) for r in rows])
    got = langid.identify(df, suffix="tld", host="host").collect()
    assert len(got) == len(rows)
    for r in got:
        lang, chance, keep = want[r["doc_id"]]
        assert r["confidence"] == pytest.approx(chance, rel=1e-3) and r["keep"] == keep, r
        if chance > 0.5:
            assert r["lang_pred"] == lang


def toxic_table(documents, sentences, n=600):
    rng = random.Random(3)
    texts, labels = [], []
    for k in range(n):
        words = sentences("en", rng.randint(5, 200)).split()
        y = int(k % 6 == 0)
        if y:
            words[rng.randrange(len(words))] = rng.choice(["idiotword", "vileword", "Scumword,"])
        texts.append(" ".join(words))
        labels.append((k, y))
    return documents(texts), labels


def test_toxicity_of_held_out_rows(spark, documents, sentences, strange, empty):
    docs, labels = toxic_table(documents, sentences)
    table = spark.createDataFrame([*labels, (None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, table)
    got = toxicity.toxicity(docs, model).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k, _ in labels if zlib.crc32(str(k).encode()) % 4 == 2}
    assert sum(r["predicted"] == labels[r["doc_id"]][1] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    # labels of held-out rows teach nothing, and learning comes out the same again
    other = spark.createDataFrame([(k, 1 - y if zlib.crc32(str(k).encode()) % 4 == 2 else y) for k, y in labels], "doc_id long, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, toxicity.train(docs.repartition(3), other)).collect()}
    assert again == {r["doc_id"]: r["score"] for r in got}
    assert len(toxicity.toxicity(strange, model).collect()) == 6 and toxicity.toxicity(empty, model).count() == 0
    assert toxicity.keep_clean(strange, model).columns == strange.columns
    nothing = toxicity.train(docs, table.limit(0))
    assert {r["score"] for r in toxicity.toxicity(docs, nothing).collect()} == {0.5}


def plain_toxicity(rows, labels, least=3, alpha=2.0, beta=1.0, l1=3.0, l2=0.1, epochs=10, seed=11):
    """Scores of rows (id, text) by FTRL-proximal over features that are spelled out."""

    def of(text):
        w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
        return {("one", x) for x in w} | {("two", *x) for x in zip(w, w[1:])} | {("skip", *x) for x in zip(w, w[2:])}

    taught = sorted((i, labels[i], len(of(t)), t) for i, t in rows if i in labels and zlib.crc32(str(i).encode()) % 4 != 2)
    counts = Counter(f for *_, t in taught for f in of(t))
    z, n, zb, nb = Counter(), Counter(), 0.0, 0.0

    def weight(f):
        return 0.0 if abs(z[f]) <= l1 else -(z[f] - math.copysign(l1, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)

    def chance(text):
        total = sum(weight(f) for f in of(text) if counts[f] >= least) - zb / ((beta + math.sqrt(nb)) / alpha)
        return 1 / (1 + math.exp(-total))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(taught)):
            _, y, _, text = taught[k]
            g = chance(text) - y
            b = -zb / ((beta + math.sqrt(nb)) / alpha)
            for f in [f for f in of(text) if counts[f] >= least]:
                w = weight(f)
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w
                n[f] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * b
            nb += g * g
    return {i: chance(t) for i, t in rows}


def test_toxicity_by_brute_force(spark, documents, sentences):
    docs, labels = toxic_table(documents, sentences, 90)
    want = plain_toxicity([(r["doc_id"], r["text"]) for r in docs.collect()], dict(labels))
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, model).collect()}
    assert got == pytest.approx(want, abs=1e-9)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_contamination(text, items):
    words = lambda t: WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for s in range(max(1, len(v) - 9) if v else 0):
            window = v[s : s + 10]
            for a in range(len(w) - len(window) + 1):
                if w[a : a + len(window)] == window:
                    hit |= set(range(a, a + len(window)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_contamination(spark, documents, sentences, broadcast):
    items = [(k, sentences("en", 25)) for k in range(5)] + [(10, "just Three words"), (11, "just three, words!"), (12, None), (13, "--"), (2, sentences("en", 12)), (14, "solo")]
    one = items[1][1].split()
    texts = [
        None,
        "",
        "just three words and just three words again",
        " ".join(one).upper(),
        "before " + ". ".join(one[3:14]) + " after",
        "before " + " ".join(one[3:12]) + " after",  # nine words are no window
        sentences("en", 300) + " " + items[0][1] + " " + sentences("en", 5) + " " + items[4][1] + " " + items[0][1],
        "Solo-solo solos",
        "été " + items[2][1],
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.contamination(docs, bench, broadcast_windows=broadcast).collect()}
    for k, t in enumerate(texts):
        assert got[k] == plain_contamination(t, items), t
    kept = decontaminate.decontaminate(docs, bench, broadcast_windows=broadcast)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [k for k in range(len(texts)) if not got[k][4]]


def test_spans_are_cut_out(spark, documents):
    item = "one two three four five six seven eight nine ten"
    docs = documents([f"(Before) {item.title()}; after!", "clean text"])
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), "spans").collect()}
    assert cut == {0: "(Before) after!", 1: "clean text"}


def test_strange_rows_of_decontamination(spark, documents, strange, empty):
    bench = spark.createDataFrame([(1, "same text here")], "item_id long, text string")
    no_id = documents(["Same text here!", "same text, here", None], ids=[None, None, None])
    assert sorted((r["n_hit"], r["n_items"]) for r in decontaminate.contamination(no_id, bench).collect()) == [(0, 0), (3, 1), (3, 1)]
    assert decontaminate.decontaminate(no_id, bench).count() == 1
    got = decontaminate.contamination(strange, bench).collect()
    assert len(got) == 6 and sorted(r["doc_id"] for r in got if r["contaminated"]) == [2, 2, 3]
    assert decontaminate.contamination(empty, bench).count() == 0
    assert {r["contaminated"] for r in decontaminate.contamination(strange, bench.limit(0)).collect()} == {False}


def plain_groups(rows, similarity=0.8):
    """The ids (the smallest of each group) that near-duplicate removal keeps of rows (id, text)."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if group[a] != group[b] and both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min(i, least.get(g, i))
    return set(least.values())


def write_tables(spark, folder, docs, labels, bench):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_by_brute_force(spark, tmp_path, documents, sentences):
    rng = random.Random(5)
    table, labels = toxic_table(documents, sentences, 240)
    rows = [(r["doc_id"], r["text"], "en") for r in table.collect()]
    bench = [(1, sentences("en", 30)), (2, "")]
    long = [sentences(lang, 120) for lang in ("de", "fr", "es", "en")]
    for k, (lang, text) in enumerate(zip(("de", "fr", "es", "en"), long)):
        rows += [(500 + 10 * k + c, text if c == 0 else " ".join(w if rng.random() > 0.004 * c else "other" for w in text.split()), lang) for c in range(5)]
    rows += [(700, sentences("en", 50) + " " + bench[0][1], "en"), (701, None, "en"), (702, "", "de"), (703, None, None), (704, "x8Kq zPv3 Lm9w QRtY uWz7 bbXq", "xx"), (705, long[0], "de")]
    rows += [(800 + k, sentences(lang, 60), lang) for k, lang in enumerate(("de", "fr", "es") * 20)]
    folder = str(tmp_path / "t")
    docs = documents([t for _, t, _ in rows], ids=[i for i, _, _ in rows], langs=[x for _, _, x in rows])
    write_tables(spark, folder, docs, labels, bench)
    spark_rows = {r["doc_id"]: (r["f"], r["source"]) for r in docs.select("doc_id", langid.fold_of(F.col("doc_id")).alias("f"), "source").collect()}
    scores = plain_toxicity([(i, t) for i, t, _ in rows], dict(labels))
    left = [r for r in rows if scores[r[0]] < 0.3]
    kept = plain_languages([(i, spark_rows[i][0], t, lang, None, spark_rows[i][1]) for i, t, lang in left])
    left = [r for r in left if kept[r[0]][2]]
    ids = plain_groups([(i, t) for i, t, _ in left])
    left = [r for r in left if r[0] in ids and not plain_contamination(r[1], bench)[4]]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: hashlib.sha256(" ".join(map(str, library.encode(t or "", add_special_tokens=False).ids)).encode()).hexdigest() for i, t, _ in left}
    assert {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, folder).collect()} == want


def test_pipeline_of_strange_tables(spark, tmp_path, strange, empty):
    write_tables(spark, str(tmp_path / "strange"), strange, [(1, 0)], [(1, "no such words")])
    got = corpus_pipeline.run(spark, str(tmp_path / "strange")).collect()
    # the empty text without declaration or source has no language; of the repeated text one row stays
    assert sorted((r["doc_id"] or 0, r["n_tokens"] > 0) for r in got) == [(0, False), (2, True), (4, True)]
    write_tables(spark, str(tmp_path / "empty"), empty, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
