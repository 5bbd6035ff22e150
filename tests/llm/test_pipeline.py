"""Stages of the corpus pipeline: rows without an id, shared ids, repeated rows, and near copies by brute force."""

import collections
import itertools
import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)


def left(df):
    assert df.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def prose(seed, n=60):
    rng = random.Random(seed)
    return [f"{rng.choice('abcdefgh')}{rng.randrange(300)}" for _ in range(n)]


def test_rules_judge_rows(spark):
    good, bad = " ".join(prose(1)), "too short"
    got = corpus_pipeline.rules(spark, docs(spark, [(None, good), (None, bad), (7, good), (7, bad), (8, good)]), SF)
    assert left(got) == {(None, good): 1, (7, good): 1, (8, good): 1}


def test_exact_judges_rows(spark):
    rows = [(None, "alone"), (None, "alone"), (None, "b"), (3, "B"), (5, "c"), (5, "d"), (9, "d"), (6, "e"), (6, "e"), (6, "e")]
    assert left(corpus_pipeline.exact(spark, docs(spark, rows), SF)) == {(None, "alone"): 1, (3, "B"): 1, (5, "c"): 1, (9, "d"): 1, (6, "e"): 1}


def test_near_judges_rows(spark):
    a, b, c = (prose(s, 120) for s in (2, 3, 4))
    close = lambda w: [*w[:50], "x", *w[51:]]
    text = " ".join
    rows = [(None, text(a)), (None, text(close(a))), (4, text(b)), (4, text(c)), (2, text(close(b))), (None, text(close(c)))]
    got = left(corpus_pipeline.near(spark, docs(spark, rows), SF))
    one = [k for k in got if k[1] in (text(a), text(close(a)))]
    assert len(one) == 1 and got == {one[0]: 1, (2, text(close(b))): 1, (4, text(c)): 1}


def test_near_matches_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for g in range(30):
        base = prose(100 + g, 120)
        rows.append((len(rows), " ".join(base)))
        for edits, span in ((1, 7), (1, 8), (1, 9), (2, 1), (3, 1)):
            w = list(base)
            for _ in range(edits):
                at = rng.randrange(5, 105)
                w[at : at + span] = [f"z{rng.randrange(10**6)}" for _ in range(span)]
            if rng.random() < 0.5:
                rows.append((len(rows), " ".join(w)))

    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    root = {i: i for i in sets}
    between = 0
    for x, y in itertools.combinations(sorted(sets), 2):
        inter, union = len(sets[x] & sets[y]), len(sets[x] | sets[y])
        between += 80 * union <= 100 * inter < 85 * union
        if 100 * inter >= 80 * union:
            old, new = max(root[x], root[y]), min(root[x], root[y])
            root = {k: new if v == old else v for k, v in root.items()}
    assert between >= 10
    got = left(corpus_pipeline.near(spark, docs(spark, rows), SF))
    assert got == {r: 1 for r in rows if root[r[0]] == r[0]}


#: Documents with more columns, under names the stages use inside.
WIDE = SCHEMA + ", row string, rid long, m int, h long, stratum string, `group` int, k int, digest string, piece int, length int"


def wide(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "r", 1, 2, 3, "x", 4, 5, "d", 6, 7) for i, t in rows], WIDE)


def test_language_judges_rows(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = table.unionByName(docs(spark, [(None, None), (None, "12 34 !!"), (5, "")])).unionByName(table.where("doc_id < 3"))
    got = left(corpus_pipeline.language(spark, rows, SF))
    assert not any((t or "").strip() in ("", "12 34 !!") for _, t in got)
    assert sum(got.values()) >= 0.97 * (table.count() + 3) and all(got[r["doc_id"], r["text"]] == 2 for r in table.where("doc_id < 3").collect() if got[r["doc_id"], r["text"]])


def test_pack_judges_rows(spark):
    rows = [(None, "a few words"), (None, "a few words"), (7, "a few words"), (7, "others"), (8, None), (9, ""), (10, "long words " * 5000)]
    got = corpus_pipeline.pack(spark, docs(spark, rows), SF).collect()
    assert collections.Counter(r["doc_id"] for r in got if r["piece"] == 0) == {None: 2, 7: 2, 8: 1, 9: 1, 10: 1}
    ends = collections.defaultdict(list)
    for r in got:
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in ends.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages_take_empty_tables_and_clashing_columns(spark):
    text = " ".join(prose(8))
    rows = [(1, text), (None, None), (2, text), (3, " ".join(prose(9)))]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark, []), SF).count() == 0
        full = wide(spark, rows)
        out = stage(spark, full, SF)
        n = out.count()
        if name == "pack":
            assert n == 4
        else:
            assert out.columns == full.columns and n <= 4, name


def test_rules_keep_no_second_copy_of_texts(spark, monkeypatch):
    written, kept = [], corpus_pipeline.saved

    def saved(df, name):
        written.append(df.schema.simpleString())
        return kept(df, name)

    monkeypatch.setattr(corpus_pipeline, "saved", saved)
    monkeypatch.setattr(corpus_pipeline.quality, "saved", saved)
    good = " ".join(prose(1))
    assert left(corpus_pipeline.rules(spark, docs(spark, [(1, good), (2, "too short")]), SF)) == {(1, good): 1}
    assert written and not any("text:" in x for x in written)
