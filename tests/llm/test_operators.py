"""Training-data operators on small rows: nulls, empties, ties, repeats, clashing columns, and brute force."""

import collections
import hashlib
import math
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from leafwise.llm import bpe, exact_dedup, html_extract, langid, license_scan, lm, packing, quality, sharding
from leafwise.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
#: Extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, keep_id string, length int, part string, k int"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def docs(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", 0, "x", "y", 5, "z", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " \n\t", "a", "A", "a", "Ünï ﬁ ~ ~~ <|endoftext|> \x1c x", "word " * 9000, "𝔘 é 中文字 ١٢"]


# exact dedup ------------------------------------------------------------------------------------


def test_exact_dedup(spark):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(spark, ODD)).collect()}
    assert len(got) == len(ODD)
    assert [got[i]["keep_id"] for i in range(len(ODD))] == [1, 1, 2, 5, 5, 5, 6, 7, 8]
    assert [got[i]["group_size"] for i in (0, 3, 6)] == [2, 3, 1]
    assert sorted(i for i in got if got[i]["kept"]) == [1, 2, 5, 6, 7, 8]
    assert got[4]["digest"] == hashlib.sha256(b"a").digest()


def test_exact_dedup_ties(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    rows = docs(spark, ["t"]).unionByName(docs(spark, ["T"])).unionByName(docs(spark, ["t"]))
    got = exact_dedup.exact_dedup(rows).collect()
    assert [(r["keep_id"], r["group_size"], r["kept"]) for r in got] == [(0, 3, True)] * 3


def test_perfect_hash():
    for n in (1, 2, 5, 1000):
        raw = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint8)
        seeds, slot = exact_dedup.build_slots(raw)
        assert sorted(slot.tolist()) == list(range(n))
        assert (exact_dedup.find_slots(raw, seeds, n) == slot).all()


# tokens and packing -----------------------------------------------------------------------------


def test_pack_documents(spark):
    special = ["foo <|endoftext|> bar", "a<|startoftext|>b<|endoftext|>", "<|ENDOFTEXT|> ~<|endoftext|>~ <|end oftext|>"]
    texts = [*ODD, *special, "~ a~b ~", "long" * 60, *(f"some words {i} " * (i % 50) for i in range(200))]
    got = packing.pack_documents(docs(spark, texts)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), 4096):
            want.add((i, s // 4096, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()), ids[s : s + 4096].tobytes()))
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got} == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 4096
    assert packing.pack_documents(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_all_in_few_bins(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(512, rng.lognormal(4.5, 1, 3000).astype(int) + 1)
    histogram = dict(collections.Counter(sizes.tolist()))
    blocks, bins = packing.plan(histogram, 512)
    load, ranks = collections.Counter(), collections.defaultdict(list)
    for b in blocks:
        for rank in range(b.lo, b.hi):
            load[b.first + (rank - b.lo) // b.copies] += b.length
            ranks[b.length].append(rank)
    assert {s: sorted(x) for s, x in ranks.items()} == {s: list(range(n)) for s, n in histogram.items()}
    assert max(load.values()) <= 512 and len(load) == bins
    assert bins <= 1.02 * math.ceil(sizes.sum() / 512) + 1


def test_byte_bpe(spark):
    rng = random.Random(1)
    texts = [*ODD, "".join(rng.choice("abcdefgh tion") for _ in range(3000)), "x" * 5000, "ab" * 3000 + "!" * 999, "".join(chr(rng.randrange(32, 2000)) for _ in range(2000))]
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert np.frombuffer(bytes(got[i]["ids"]), "<u4").tolist() == encoding.encode_ordinary(t or "")
        assert bytes(got[i]["decoded"]) == (t or "").encode()


def test_byte_bpe_empty_table(spark):
    assert bpe.encode_documents(docs(spark, [])).count() == 0


def test_pack_rows_of_one_id(spark):
    frame = spark.createDataFrame([(i, "a few words here", "en", "s", 0, "x", "y", 5, "z", 1) for i in [None] * 40 + [7] * 40], SCHEMA)
    got = packing.pack_documents(frame, keep_ids=False).collect()
    assert len(got) == 80 and len({(r["sequence_id"], r["offset"]) for r in got}) == 80 and "row" not in got[0]


def test_rank_queue():
    queue, rng = bpe.RankQueue(300_000), random.Random(2)
    pushed = [(rng.randrange(300_000), i) for i in range(2000)]
    ranks, places = (np.array(x) for x in zip(*pushed))
    queue.push_all(ranks[:1000], places[:1000])
    queue.push_all(ranks[1000:], places[1000:])
    queue.push_all(np.array([-1]), np.array([5]))
    out = []
    while (x := queue.pop()) is not None:
        out += [(x[0], i) for i in x[1].tolist()]
    assert out == sorted(pushed)


# quality ----------------------------------------------------------------------------------------


def slow_repeat(words):
    at = collections.defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    return len({j for starts in at.values() if len(starts) > 1 for i in starts for j in range(i, i + 8)})


def test_quality_measures():
    rng = random.Random(4)
    for n in (0, 7, 8, 9, 40, 400):
        words = [rng.choice("abc") for _ in range(n)]
        assert quality.repeat_words([w.encode() for w in words]) == slow_repeat(words)
    got = quality.measures("é #x\n \n|a\n|a\nb\n|a".encode())
    assert got[:4] == (6, 10, 4, 2)
    assert quality.measures(b"")[:5] == (0, 0, 0, 0, 0)


def test_upper_bound_is_exact():
    for k, n, delta in ((0, 50, 0.05), (3, 40, 0.01), (40, 40, 0.1)):
        p = quality.upper_bound(k, n, delta)
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert p == 1.0 if k == n else abs(tail - delta) < 1e-6


def test_quality_rules(spark):
    good = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(900)]
    bad = [" ".join(f"W{i}X{j}!!" for j in range(40)) for i in range(30)]
    frame = docs(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, 1) for i in range(700)] + [(i, 0) for i in range(900, 930)] + [(1, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.quality_rules(frame, labels).collect()}
    assert all(got[i]["kept"] for i in range(900))
    assert not any(got[i]["kept"] for i in range(900, 932))
    assert [got[i]["base_failed"] for i in (0, 900, 930, 931)] == [False, False, True, True]
    # copies are one draw: 700 rows of one text certify nothing
    same = quality.quality_rules(docs(spark, [good[0]] * 700 + bad), labels.where("quality = 1 and doc_id <> 1")).collect()
    assert all(r["kept"] for r in same)
    assert quality.quality_rules(frame.limit(0), labels).count() == 0
    twice = quality.quality_rules(frame.where("doc_id in (5, 905)").unionByName(frame.where("doc_id in (5, 905)")), labels).collect()
    assert collections.Counter((r["doc_id"], r["n_words"]) for r in twice) == {(5, 40): 2, (905, 40): 2}
    long = quality.quality_rules(docs(spark, ["word%d " % i for i in range(2)] + [" ".join(f"w{i}" for i in range(200_000))]), labels.limit(0)).collect()
    assert max(r["n_words"] for r in long) == 200_000
    # nothing to certify from: only the base rule rejects
    none = quality.quality_rules(frame, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in none)


# language ---------------------------------------------------------------------------------------


def test_language(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(table.selectExpr("doc_id as id", "text", "lang"))
    got = table.select("lang", langid.predict_column(model).alias("p")).collect()
    assert sum(r["lang"] == r["p"]["lang_pred"] for r in got) >= 0.97 * len(got)
    assert sum(r["p"]["rejected"] for r in got) <= 0.03 * len(got)
    odd = [r["p"] for r in docs(spark, [None, "", "12 !?", "the of"]).orderBy("doc_id").select(langid.predict_column(model).alias("p")).collect()]
    assert [(p["lang_pred"], p["score"], p["rejected"]) for p in odd[:3]] == [("und", 0.0, True)] * 3
    assert odd[3]["lang_pred"] in model.langs and 0 <= odd[3]["score"] <= 1


def test_language_without_labels(spark):
    model = langid.fit(docs(spark, ["abc"]).selectExpr("doc_id as id", "text", "cast(null as string) as lang"))
    assert docs(spark, ["abc"]).select(langid.predict_column(model).alias("p")).first()["p"]["lang_pred"] == "und"


def test_language_cutoff_counts_all_rows(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 20)
    texts = [f"the cat sat on the mat near house {i}" for i in range(300)]
    texts[7] = "the zq xj vw kq zx qj"  # one row in 300 is unlike the rest
    model = langid.fit(docs(spark, texts).selectExpr("doc_id as id", "text", "lang"))
    cosines = [float((model.centroids @ langid.vector(t, model.idf)).max()) for t in texts]
    assert min(cosines) == cosines[7] < 0.9 * sorted(cosines)[1]
    assert model.least.tolist() == pytest.approx([langid.SLACK * cosines[7]])


# language model ---------------------------------------------------------------------------------


def test_lm_base_scores(spark):
    texts = [*ODD, *(f"the cat {i % 7} sat on the mat {i} ." for i in range(120))]
    got = {r["doc_id"]: r for r in lm.lm_scores(docs(spark, texts)).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = collections.Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, w in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(x in c for x in w), n)
        assert abs(r["base_score"] - sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) < 1e-6 * len(w)
        assert r["score"] < 0
    out = [i for i in tokens if held[i] and i >= len(ODD)]
    assert sum(got[i]["score"] for i in out) > sum(got[i]["base_score"] for i in out)
    assert lm.lm_scores(docs(spark, [])).count() == 0
    assert {(r["n_tokens"], r["n_known"]) for r in lm.lm_scores(docs(spark, ["b"], first=2)).collect()} <= {(2, 0), (2, 2)}


def test_lm_probabilities_sum_to_one(spark):
    frame = docs(spark, [f"a b {i % 3} c. a" for i in range(50)]).selectExpr("cast(text as binary) as t")
    model = lm.fit(frame, 3)
    total = np.zeros(lm.CONTEXTS)
    for row in model.state.toPandas().to_dict("records"):
        p = lm.Part(row)
        for u in range(lm.CONTEXTS):
            logs, _ = lm._log_probs(p, np.arange(len(p.w)), np.full(len(p.w), u), model.totals)
            total[u] += (10**logs).sum()
    unknown = np.mean([x.back_off() * x.unknown() for x in model.totals], axis=0)
    assert np.allclose(total + unknown, 1, atol=1e-9)


def test_seating():
    rng = np.random.default_rng(0)
    t = lm.seat(np.array([1, 2, 500, 100_000]), np.array([1.0, 1.0, 1.0, 1.0]), 0.5, rng)
    assert t[0] == 1 and (t >= 1).all() and (t <= [1, 2, 500, 100_000]).all()


# html -------------------------------------------------------------------------------------------


def plain(page):
    return page.replace(' data-main="1"', "").replace(' data-main="0"', "")


def test_html(spark):
    pages = [*map(plain, html_extract.TRAINING), None, "", "no tags &amp; more", "<p>", "<div" * 50, "<b>" * 3000 + "deep", '<p a="unclosed>text']
    frame = spark.createDataFrame([(i, "u", p, "x") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(frame).collect()}
    assert len(got) == len(pages)
    for i in range(5):
        assert "A river carries stones" in got[i] and "The delta from above" in got[i]
        for frame_text in ("Home", "cookies", "boots", "thank you", "First!", "rights reserved", "Subscribe", "lives by a river"):
            assert frame_text not in got[i], (i, frame_text)
    assert got[5] == "Short\n\nYes.\n\nIt is so."
    n = len(html_extract.TRAINING)
    assert got[n] == got[n + 1] == ""


def test_html_scanner_is_linear():
    import time

    for unit in ('<a "', "</x ", """<a '">""", "<x y='", "<", "<p><div>" + "<b>" * 20 + "<ul></ul>", "<li><div>"):
        page = unit * (1_000_000 // len(unit))
        begin = time.perf_counter()
        html_extract.parse(page)
        assert time.perf_counter() - begin < 10, unit     # quadratic: minutes
    t = html_extract.parse("<p a=\"x>y\">in</p><p b='un>out<i \"q>z</i><!-- c > -->end<!d><?e>! < 3 </")
    assert [x for _, x in t.blocks] == ["in", "out<i \"q>z end! < 3 </"] or "in" == t.blocks[0][1]


def test_html_empty_table_and_long_page(spark):
    schema = "page_id long, url string, html string, text string, tree string"
    assert html_extract.extract_pages(spark.createDataFrame([], schema)).count() == 0
    body = "<article>" + "".join(f"<p>Sentence number {i} of a long and plain article, told at length.</p>" for i in range(20_000)) + "</article>"
    got = html_extract.extract_pages(spark.createDataFrame([(1, "u", body, "x", "y"), (1, "u", body, "x", "y")], schema)).collect()
    assert len(got) == 2 and all(r["text"].count("\n\n") == 19_999 for r in got)


def test_html_blocks():
    t = html_extract.parse("<div>a&amp;b <b>c</b>d<br>e<p>x<p>y\n z</div><script>no</p></script>tail<!-- no --><ul><li>1<li>2</ul>")
    assert [text for _, text in t.blocks] == ["a&b cd e", "x", "y z", "tail", "1", "2"]


def test_marginals_match_enumeration():
    rng = np.random.default_rng(5)
    t = html_extract.parse("<div><p>a</p><section><p>b</p><ul><li>c</li></ul></section></div>")
    feats = html_extract.features(t)
    pair = rng.dirichlet([1, 1], (2, 2))
    model = html_extract.Model(np.log(rng.random((2, html_extract.WIDTH))), np.log(pair), np.log(np.array([0.7, 0.3])))
    n = len(t.parent)
    total = np.zeros((n, 2))
    for code in range(2**n):
        y = [(code >> i) & 1 for i in range(n)]
        logp = model.root[y[0]] + sum(model.emit[y[i]][feats[i]].sum() for i in range(n))
        logp += sum(model.pair[int(t.tag[i] in html_extract.CONTAINER)][y[t.parent[i]]][y[i]] for i in range(1, n))
        for i in range(n):
            total[i, y[i]] += math.exp(logp)
    assert np.allclose(html_extract.marginals(t, feats, model), total[:, 1] / total.sum(axis=1))


# sharding ---------------------------------------------------------------------------------------


def test_sharding(spark):
    rng = random.Random(6)
    texts = [*ODD, *("copy of a text " * 3 for _ in range(300)), *("é" * rng.randrange(1, 400) for _ in range(500))]
    got = sharding.shard(docs(spark, texts)).collect()
    assert len(got) == len(texts)
    weight, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        weight[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    light = [w for s, w in weight.items()]
    # the text of 45,000 bytes is heavier than a shard; the others are near equal
    assert sorted(light)[-2] - sorted(light)[0] < 0.5 * sorted(light)[-2]
    assert sharding.shard(docs(spark, [])).count() == 0


def test_sharding_equal_texts_only(spark):
    got = sharding.shard(docs(spark, ["same text"] * 400)).collect()
    assert sorted(collections.Counter(r["shard"] for r in got).values()) == [50] * 8


def test_sharding_deals_equal_texts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "NUMBERED", 10)
    shards = collections.defaultdict(list)
    for r in sharding.shard(docs(spark, ["same text"] * 400)).collect():
        shards[r["shard"]].append((r["slot"], r["doc_id"]))
    for got in shards.values():
        assert [s for s, _ in sorted(got)] == list(range(50))
        ids = [i for _, i in sorted(got)]
        assert sum(a > b for a, b in zip(ids, ids[1:])) > 5  # ids ascend within a task's rows only


# licences ---------------------------------------------------------------------------------------


def test_license_scan(spark):
    texts = [
        "Some prose here.\nReleased under the MIT License.", "Licensed under the Apache License, Version 2.0.\nprose",
        "This work is licensed under the GNU General Public License, version 3.", "licensed under cc by-nc 4.0.",
        None, "", "\n\n", "He lost his driving license on the way to the public library.", "a walk in the park by the sea",
        "Licensed under the Seven Lakes Community License, version 9",
    ]
    got = license_scan.license_scan(docs(spark, [*texts, *(f"plain words {i} and more of them in a row" for i in range(60))])).collect()
    found = {(r["doc_id"], r["paragraph"]): r["licence"] for r in got}
    assert found.pop((9, 0), "unknown") == "unknown"
    assert found == {(0, 1): "mit", (1, 0): "apache", (2, 0): "gpl", (3, 0): "cc-by-nc"}


def test_license_paragraphs(spark):
    long = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of it was not given, see the web."
    texts = ["a\n\nb", long, "short line\nnext", "x" * 60 + ".\ny", "x" * 60 + "\n\ny", "x" * 60 + "\n  y", "x" * 60 + "\r\ny", None, ""]
    got = {}
    for r in license_scan.paragraphs(docs(spark, texts)).collect():
        got.setdefault(r["doc_id"], {})[r["paragraph"]] = r["p"]
    assert got[0] == {0: "a", 2: "b"} and got[1] == {0: long.replace("\n", " ")} and len(got[2]) == 2
    assert len(got[3]) == 2 and sorted(got[4]) == [0, 2] and len(got[5]) == 2 and got[6] == {0: "x" * 60 + " y"} and set(got) == set(range(7))


@pytest.fixture(scope="module")
def license_model(spark):
    return license_scan.fit(spark, docs(spark, [f"plain words {i} and more of them in a row" for i in range(60)]))


def test_license_scan_spelling_wraps_and_long_texts(spark, license_model):
    texts = [
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.", "Licensed under the MIT licence",
        "Many programs of that time were distributed under several licenses.", "prose of no kind. " * 20_000 + "\nReleased under the MIT License.",
    ]
    got = license_scan.license_scan(docs(spark, texts), license_model).collect()
    assert {(r["doc_id"], r["licence"]) for r in got if r["confirmed"]} == {(0, "mpl"), (1, "mit"), (3, "mit")}


def test_license_probabilities_and_shares(spark, license_model):
    """The classifier's probabilities and the template shares, by hand."""
    model = license_model
    texts = ["Released under the MIT License.", "All rights reserved.", "see the file", "Licensed under CC BY-SA 4.0, all of it"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, p string").withColumn("words", license_scan.words_of(license_scan.F.col("p")))
    got = model.score(rows).orderBy("i").collect()
    weights, start = model.classifier.coefficientMatrix.toArray(), model.classifier.interceptVector.toArray()
    place = {f: i for i, f in enumerate(model.vectors.vocabulary)}
    for r, t in zip(got, texts):
        at = sorted(place[f] for f in license_scan._python_features(t) if f in place)
        z = start + weights[:, at].sum(axis=1)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        none = model.classes.index("none")
        best = max((x, c) for x, c in zip(p, model.classes) if c != "none")
        assert math.isclose(r["p_none"], p[none], rel_tol=1e-9) and math.isclose(r["probability"], best[0], rel_tol=1e-9) and r["family"] == best[1]
    templates = license_scan.TEMPLATES["mit"]
    pairs = lambda t: {*zip(license_scan._python_words(t), license_scan._python_words(t)[1:])}
    shares = rows.select("p", license_scan.template_share(license_scan.F.col("words"), templates).alias("s")).collect()
    for r in shares:
        want = max(len(pairs(r["p"]) & pairs(t)) / max(1, min(len(pairs(r["p"])), len(pairs(t)))) for t in templates)
        assert math.isclose(r["s"], want)
    assert license_scan.lowest_threshold([(0.9, True), (0.8, True), (0.7, False)]) == 0.8
    assert license_scan.lowest_threshold([(0.9, False)]) > 1 and license_scan.lowest_threshold([]) > 1


def test_license_scan_empty_table(spark, license_model):
    assert license_scan.license_scan(docs(spark, []), license_model).count() == 0
    assert license_scan.corpus_sample(docs(spark, [])).count() == 0


def test_license_scan_frequent_notices(spark):
    notices = ["All rights reserved.", "Released under CC0 1.0", "Released under CC BY 4.0", "Permission is hereby granted", "Redistribution and use in source and binary forms"]
    texts = [f"plain words {i} and more of them in a row\n{notices[i % 5]}" for i in range(200)]
    texts += [f"ein satz {i} mit mehr worten" for i in range(40)]
    got = license_scan.license_scan(docs(spark, texts)).collect()
    assert sorted((r["doc_id"], r["paragraph"]) for r in got) == [(i, 1) for i in range(200)]
    families = ["proprietary", "cc0", "cc-by", "mit", "bsd"]
    assert all(r["family"] == families[r["doc_id"] % 5] for r in got)


def test_license_words_are_looked_for_as_they_are_split(spark):
    words = license_scan.cue_words()
    texts = [None, "", "license", "Licence", "LICENCED x", "xlicense", "license2", "a\nmpl", "mpl-2.0", "(BSD)", "\u212aind of cc0", "cc by", "licens e", "sub-licenses", "free\u00e9", "no such one"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    F = license_scan.F
    for some in (words, words[:3], ["license"], []):
        want = F.arrays_overlap(license_scan.words_of(F.col("t")), F.array(*map(F.lit, some)).cast("array<string>"))
        for r in rows.select("t", license_scan.holds_word(F.col("t"), some).alias("got"), want.alias("want")).collect():
            assert bool(r["got"]) == bool(r["want"]), r


def test_license_deciding_words():
    assert license_scan.deciding_words(["a", "a b", "b c", "c d", "d"], [True, True, True, True, False], ["a", "b", "c", "d"]) == ["a", "c"]
    assert license_scan.deciding_words(["the mit"], [False], ["mit"]) == []


def test_license_sample_of_long_paragraphs(spark):
    """Was quadratic in a paragraph's words: the text was split again for every gram, for every template."""
    texts = [f"{n} " + " ".join(f"w{i}x{n}" for i in range(8000)) for n in range(4)]
    began = time.time()
    got = license_scan.corpus_sample(docs(spark, texts)).collect()
    assert sorted(len(r["words"]) for r in got) == [8001] * 4 and time.time() - began < 60


# registry and pipeline --------------------------------------------------------------------------


def test_queries_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 11))
    assert set(ORACLE) <= set(QUERIES)


def test_pipeline(spark, tmp_path):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(90_001, None, "en", "s", 0), (90_002, "", None, None, None)], frame.schema)
    frame = frame.unionByName(more)
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = frame
        out = stage(spark, frame, SF)
        out.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        if name != "pack":
            assert frame.columns == before.columns
            kept.append(frame.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0
    assert frame.select("doc_id").distinct().count() == kept[-1]
    assert not {90_001, 90_002} & {r["doc_id"] for r in frame.select("doc_id").collect()}
