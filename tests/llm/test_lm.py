"""Seating of the hierarchical Pitman-Yor process against enumerated seatings."""

import numpy as np
import pytest

from leafwise.llm import lm


def seatings(c):
    """All partitions of ``c`` customers, as lists of table sizes."""
    if not c:
        yield []
        return
    for p in seatings(c - 1):
        yield from (p[:i] + [p[i] + 1] + p[i + 1 :] for i in range(len(p)))
        yield [*p, 1]


def table_probabilities(c, d, new):
    """Probability of every number of tables."""
    out = np.zeros(c + 1)
    for p in seatings(c):
        weight = np.prod([new(k) for k in range(1, len(p))])
        out[len(p)] += weight * np.prod([m - d for n in p for m in range(1, n)])
    return out / out.sum()


@pytest.mark.parametrize("together", [100, 10**9])
@pytest.mark.parametrize("c", [2, 3, 6])
def test_reseating_keeps_the_probabilities_of_seatings(c, together, monkeypatch):
    monkeypatch.setattr(lm, "TOGETHER", together)
    n, d, rng = 4000, 0.6, np.random.default_rng(5)
    new = lm.New(np.full(n, 1.3), d, 2.0, 9.0, 1)
    want = table_probabilities(c, d, lambda t: (1.3 + d * t) * (2 + t) / (9 + t))
    customers, t, sizes = np.full(n, c), np.ones(n, np.int64), np.full(n, c)
    got = np.zeros(c + 1)
    for i in range(30):
        t, sizes = lm.reseat(customers, t, sizes, new, d, rng)
        assert (np.bincount(np.repeat(np.arange(n), t), weights=sizes) == c).all()
        if i >= 10:
            got += np.bincount(t, minlength=c + 1)
    assert np.abs(got / got.sum() - want).max() < 0.012


@pytest.mark.parametrize("together", [100, 10**9])
def test_customers_are_seated_one_after_the_other(together, monkeypatch):
    monkeypatch.setattr(lm, "TOGETHER", together)
    c, d, a, n = 300, 0.5, 2.0, 400
    p = np.zeros(c + 2)
    p[1] = 1.0
    k = np.arange(c + 2)
    for j in range(1, c):
        opens = a / (a + np.maximum(j - d * k, 0))
        p = np.append(0, (p * opens)[:-1]) + p * (1 - opens)
    mean = (p * k).sum()
    sd = np.sqrt((p * k * k).sum() - mean**2)
    t = lm.seat(np.full(n, c), np.full(n, a), d, np.random.default_rng(2))
    assert abs(t.mean() - mean) < 4 * sd / np.sqrt(n)


def test_dishes_of_all_sizes_keep_their_order(monkeypatch):
    monkeypatch.setattr(lm, "GROUP", 50)
    rng = np.random.default_rng(1)
    c = rng.permutation(np.r_[np.ones(40, np.int64), rng.integers(2, 20, 60), 700, 90, 65, 64])
    t, sizes = np.zeros(len(c), np.int64), np.zeros(0, np.int64)
    for _ in range(3):
        t, sizes = lm.reseat(c, t, sizes, lm.New(np.full(len(c), 3.0)), 0.4, rng)
        assert (np.bincount(np.repeat(np.arange(len(c)), t), weights=sizes, minlength=len(c)) == c).all() and (sizes > 0).all()
    more = c + 2
    t, sizes = lm.reseat(more, t, sizes, lm.New(np.full(len(c), 3.0)), 0.4, rng)
    assert sizes.sum() == more.sum()
    t, sizes = lm.leave(c, t, sizes, rng)
    assert (np.bincount(np.repeat(np.arange(len(c)), t), weights=sizes, minlength=len(c)) == c).all()
    assert [x.tolist() for x in lm.reseat(*[np.zeros(0, np.int64)] * 3, lm.New(np.zeros(0)), 0.4, rng)] == [[], []]


def test_state_holds_every_customer(spark):
    frame = spark.createDataFrame([(f"a b {i % 3} c. a",) for i in range(60)], "text string").selectExpr("cast(text as binary) as t")
    model = lm.fit(frame, 3)
    for row in model.state.toPandas().to_dict("records"):
        p = lm.Part(row)
        for c, t, kept in ((p.c, p.t[-1], row["s"]), (p.to_root(p.t[-1]), p.t0[-1], row["s0"])):
            sizes = lm._sizes(c, t, kept)
            assert (np.bincount(np.repeat(np.arange(len(c)), t), weights=sizes, minlength=len(c)) == c).all()


def test_chunk_numbers_words_by_part_and_hash():
    texts = [b"", b"A b. a", b" \n", b"b. 7 a \xc3\xa9 x", "wörter".encode() * 20]
    chunk = lm.Chunk()
    for t in texts:
        chunk.add(t)
    hashes, part, token, context, text = chunk.arrays(3)
    want = [(lm.xxhash.xxh3_64_intdigest(w), int(lm._CLASS[before[-1]]) if before else lm.START, i)
            for i, t in enumerate(texts) for before, w in zip([b"", *t.lower().split()], [*t.lower().split(), lm.END])]
    assert list(zip(hashes[token].tolist(), context.tolist(), text.tolist())) == want
    assert part.tolist() == (hashes % np.uint64(3)).tolist()
    assert list(zip(part.tolist(), hashes.tolist())) == sorted(set(zip(part.tolist(), hashes.tolist())))


TEXTS = [f"the {a}n sat on {b} mat{i % 9}. A b {i % 4}" for i in range(60) for a, b in [(f"cat{i % 3}", "a" if i % 3 else "no")]] + ["", "one", None, "é b é"]


def frame_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def tokens_of(text):
    return [*(text or "").encode().lower().split(), lm.END]


def model_of(spark, frame, parts):
    train = frame.where(lm.fold("doc_id") != 1).select(lm.text_bytes().alias("t"))
    model = lm.fit(train, parts)
    homes = {}
    for r in model.homes.collect():
        v = np.frombuffer(bytes(r["hv"]), np.uint64)
        c, ts = lm.unpack(r["hc"], len(v)), [lm.unpack(t, len(v)) for t in r["ht"]]
        homes |= {int(x): (int(c[i]), [int(t[i]) for t in ts]) for i, x in enumerate(v)}
    return model, [lm.Part(r) for r in model.state.toPandas().to_dict("records")], homes


def by_hand(model, parts, homes):
    """Probability of a word (None: unknown) after a context, by plain loops."""
    low, mid, top, total = {}, {}, {}, model.totals
    for p in parts:
        for i, w in enumerate(p.w.tolist()):
            top[w] = [(int(p.to_root(t)[i]), int(t0[i])) for t, t0 in zip(p.t, p.t0)]
        for j, w in enumerate(p.w[p.word].tolist()):
            mid[w, int(p.u[j])] = [(int(c[j]), int(t[j])) for c, t in zip(p.cs, p.t)]
        for j, w in enumerate(p.w[p.of].tolist()):
            low[w, int(p.v[p.x[j]])] = [(int(p.b[j]), int(t[j])) for t in p.tb]
    none = [(0, 0)] * len(total)

    def probability(w, u, k):
        out = []
        for i, x in enumerate(total):
            (c0, t0), (c, t), (b, tb) = top.get(w, none)[i], mid.get((w, k), none)[i], low.get((w, u), none)[i]
            root = (max(c0 - x.d0 * t0, 0) + (lm.STRENGTH + x.d0 * x.tables0) / (x.words + 1)) / (lm.STRENGTH + x.tables.sum())
            parent = (max(c - x.d * t, 0) + (lm.STRENGTH + x.d * x.tables[k]) * root) / (lm.STRENGTH + x.customers[k])
            customers, opened = homes.get(u, (0, [0] * len(total)))
            out.append((max(b - x.d_b * tb, 0) + (lm.STRENGTH + x.d_b * opened[i]) * parent) / (lm.STRENGTH + customers))
        return np.mean(out)

    return probability, top, low


def hashed(w):
    return lm.xxhash.xxh3_64_intdigest(w)


def test_scores_are_of_words_after_words(spark, monkeypatch):
    """Every context is the preceding word: counts, totals and scores against plain loops."""
    monkeypatch.setattr(lm, "LEAST_PARTS", 3)
    frame = frame_of(spark, TEXTS)
    model, parts, homes = model_of(spark, frame, 3)
    probability, words, low = by_hand(model, parts, homes)
    klass = lambda u: int(lm._CLASS[u[-1]]) if u else lm.START
    held = {r["doc_id"] for r in frame.where(lm.fold("doc_id") == 1).collect()}
    want, context = {}, {}
    for i, t in enumerate(TEXTS):
        for u, w in zip([lm.END, *tokens_of(t)], tokens_of(t)):
            if i not in held:
                want[hashed(w), hashed(u)] = want.get((hashed(w), hashed(u)), 0) + 1
                context[u] = context.get(u, 0) + 1
    assert {x: b[-1][0] for x, b in low.items()} == want and set(words) == {w for w, _ in want}
    assert {u: c for u, (c, _) in homes.items()} == {hashed(u): n for u, n in context.items()}
    for i in range(len(model.totals)):
        opened = {}
        for (_, u), b in low.items():
            opened[u] = opened.get(u, 0) + b[i][1]
        assert opened == {u: t[i] for u, (_, t) in homes.items()}
    for u in (*context, b"unseen"):
        assert abs(sum(probability(w, hashed(u), klass(u)) for w in (*words, None)) - 1) < 1e-9
    for r in lm.lm_scores(frame).collect():
        t = tokens_of(TEXTS[r["doc_id"]])
        score = sum(np.log10(probability(hashed(w), hashed(u), klass(u))) for u, w in zip([lm.END, *t], t))
        assert abs(r["score"] - score) < 1e-9 * len(t), r


def test_pairs_of_words_are_learnt(spark):
    """Texts of the same words after words of the same class: only the pairs tell them apart."""
    pairs = [("aax", "bby"), ("ccx", "ddy"), ("eex", "ffy")]
    texts = [f"{a} {b}" for a, b in pairs] * 40
    held = [r["doc_id"] for r in frame_of(spark, texts).where(lm.fold("doc_id") == 1).orderBy("doc_id").collect()]
    wrong = {}
    for n, i in enumerate(held):
        a, b = pairs[n % 3][0], pairs[(n // 3 + n) % 3][1]
        texts[i], wrong[i] = f"{a} {b}", (a, b) not in pairs
    got = {r["doc_id"]: r["score"] for r in lm.lm_scores(frame_of(spark, texts)).collect()}
    assert len(set(wrong.values())) == 2
    assert min(got[i] for i in held if not wrong[i]) > max(got[i] for i in held if wrong[i]) + 0.5


def test_pack():
    x = np.array([0, 1, 254, 255, 256, 2**40, 3])
    assert lm.unpack(lm.pack(x), len(x)).tolist() == x.tolist() and lm.pack(x[:3]) == bytes([0, 1, 254])
    assert lm.unpack(b"", 0).tolist() == []


def test_rows_of_a_part_merge_alike():
    """Whether or not the chunks meet in groups first; counts beyond 32 bits included."""
    u64 = lambda *x: np.array(x, np.uint64).tobytes()
    u32, u8 = (lambda *x, kind=kind: np.array(x, kind).tobytes() for kind in (np.uint32, np.uint8))
    rows = [(0, u64(5, 9), u32(2, 1), u64(7, 8, 7), u8(1, 2, 1), u32(2**32 - 1, 1, 4)), (0, u64(9), u32(1), u64(7), u8(1), u32(3)), (0, u64(5), u32(1), u64(7), u8(1), u32(9))]
    frame = lm.pd.DataFrame(rows, columns=lm._names(lm.PAIRS))
    want = [[5, 5, 9], [7, 8, 7], [1, 2, 1], [2**32 + 8, 1, 7]]
    assert [x.tolist() for x in lm._merge(frame)] == want
    assert [x.tolist() for x in lm._merge(lm._merge_rows(frame))] == want
