"""Leaks against comparing all windows, and edited copies."""

import random

from siltstone.llm import leaks


def brute(docs, items, n=12):
    grams = {}
    for i, t in items:
        w = leaks.words(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = leaks.words(t)
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def test_words():
    assert leaks.words("Ab_c ÉTÉ-9, İx Привет") == ["ab", "c", "été", "9", "i̇x", "привет"]
    assert leaks.words(None) == leaks.words("") == leaks.words("_ -") == []


def test_found(spark):
    r = random.Random(0)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 11, 12, 40])))) for i in range(20)] + [(90, None), (91, ""), (92, "w1 w2"), (93, "same words " * 8), (94, "same words " * 8)]
    docs = []
    for d in range(120):
        text = [r.choice(vocabulary) for _ in range(r.randrange(60))]
        if r.random() < 0.7:
            w = leaks.words(r.choice(items)[1])
            n = r.choice([5, 11, 12, 13, 40])
            k = r.randrange(max(1, len(w) - n + 1))
            text[5:5] = w[k : k + n]
        docs.append((d, r.choice([" ", "_", ", "]).join(text).upper()))
    docs += [(500, None), (501, ""), (502, "same WORDS " * 7), (503, "x " * 100_000 + (items[3][1] or "")), (3, docs[3][1])]
    df = spark.createDataFrame([(*x, 1, "z") for x in docs], "doc_id long, text string, score int, words string")
    it = spark.createDataFrame([(*x, "k") for x in items], "item_id long, text string, kind string")
    pairs = leaks.find_leaks(df, it).where("run >= 12").select("doc_id", "item_id").collect()
    got = [tuple(p) for p in pairs]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items)


def test_edited_copy_scores_high(spark):
    item = " ".join(f"word{i}" for i in range(40))
    edited = " ".join("other" if i % 9 == 8 else f"word{i}" for i in range(40) if i != 22)
    df = spark.createDataFrame([(1, "before it " + edited + " after"), (2, "nothing of the kind")], "doc_id long, text string")
    got = leaks.find_leaks(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 7)] and got[0]["share"] > 0.6 and got[0]["run"] < 12


def test_edited_copies_beside_whole_ones(spark):
    """All pairs aligned: copies with a word in every five or so changed, added or dropped, beside whole copies."""
    import numpy as np

    r = random.Random(2)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, [r.choice(vocabulary) for _ in range(r.choice([12, 14, 25, 60, 110]))]) for i in range(12)]
    docs = [(i, ["a", *ws, "b"]) for i, ws in items for _ in range(3)]
    for _ in range(150):
        ws, every, kind, out = r.choice(items)[1], r.choice([2, 3, 4, 5, 6, 8, 12]), r.randrange(4), []
        for k, w in enumerate(ws):
            last = k % every == every - 1
            out += [w, "new"] if last and kind == 1 else [] if last and kind == 2 else ["new"] if last and (kind == 0 or r.random() < 0.5) else [w]
        around = [r.choice(vocabulary) for _ in range(r.choice([0, 50, 250]))]
        docs.append((0, around + out + around[:90]))
    docs = [(d, ws) for d, (_, ws) in enumerate(docs)]
    number = {w: k for k, w in enumerate([*vocabulary, "new", "a", "b"])}
    code = lambda ws: np.array([number[w] for w in ws], np.int32)
    pairs = [(d, i, code(x), code(y)) for d, x in docs for i, y in items]
    scores, runs = leaks.align_many([x for _, _, x, _ in pairs], [y for _, _, _, y in pairs])
    want = {(d, i, int(s), int(n)) for (d, i, _, y), s, n in zip(pairs, scores, runs) if s >= max(24, len(y)) or n >= 12}
    df = spark.createDataFrame([(d, " ".join(ws)) for d, ws in docs], "doc_id long, text string")
    it = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id long, text string")
    got = leaks.find_leaks(df, it, edited=True).where("share >= 0.5 and score >= 24 or run >= 12").collect()
    assert len(want) > 120 and {(x["doc_id"], x["item_id"], x["score"], x["run"]) for x in got} == want and len(got) == len(want)
    assert leaks.find_leaks(df, it.where("item_id < 0"), edited=True).collect() == leaks.find_leaks(df.where("false"), it, edited=True).collect() == []


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks.find_leaks(docs, none).collect() == []
    item = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    assert leaks.find_leaks(docs.where("false"), item).collect() == []


def test_align():
    import numpy as np

    a = np.array([1, 2, 3, 9, 4, 5])
    assert leaks.align(a, np.array([1, 2, 3, 4, 5])) == (9, 3)
    assert leaks.align(np.array([7]), np.array([8])) == (0, 0)


def test_many_pairs_align_as_single_ones(monkeypatch):
    import numpy as np

    def plain(a, b):
        score, runs, best, longest = {}, {}, 0, 0
        for i, x in enumerate(b):
            for j, y in enumerate(a):
                score[i, j] = max(0, score.get((i - 1, j - 1), 0) + (2 if x == y else -1), score.get((i - 1, j), 0) - 1, score.get((i, j - 1), 0) - 1)
                runs[i, j] = runs.get((i - 1, j - 1), 0) + 1 if x == y else 0
                best, longest = max(best, score[i, j]), max(longest, runs[i, j])
        return best, longest

    monkeypatch.setattr(leaks, "CHUNK_CELLS", 300)
    r = random.Random(1)
    make = lambda n: [np.array([r.randrange(5) for _ in range(r.randrange(1, n))]) for _ in range(80)]
    a, b = make(40), make(20)
    scores, runs = leaks.align_many(a, b)
    assert [(int(s), int(k)) for s, k in zip(scores, runs)] == [plain(list(x), list(y)) for x, y in zip(a, b)]


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    """Items over many blocks, one longer than a block, and an item id of several passages."""
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice([12, 30, 200]))) for i in range(12)] + [(3, text(20)), (3, text(15))]
    docs = [(d, " ".join([text(30), " ".join(leaks.words(r.choice(items)[1])[: r.choice([8, 14, 60])]), text(500 if d % 9 == 0 else 10)])) for d in range(60)]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for edited in (False, True):
        whole = {tuple(x) for x in leaks.find_leaks(df, it, edited).where("run >= 12").select("doc_id", "item_id", "run").collect()}
        monkeypatch.setattr(leaks, "BLOCK_WORDS", 60)
        assert {tuple(x) for x in leaks.find_leaks(df, it, edited).where("run >= 12").select("doc_id", "item_id", "run").collect()} == whole
        monkeypatch.undo()
        assert {x[:2] for x in whole} == brute(docs, items)


def test_one_long_item_widens_only_its_own_stretches(spark):
    import numpy as np
    import pyarrow as pa

    long, short = [f"a{i}" for i in range(3000)], [f"b{i}" for i in range(12)]
    known = type("Known", (), {"value": leaks.reaches([long, short])})()
    text = " ".join(["x"] * 500 + short + ["y"] * 500)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "text": [text]})
    [out] = leaks.find_stretches(known)(iter([batch]))
    assert out.column("start").to_pylist() == [500 - 24] and len(out.column("words")[0]) == 12 + 2 * 24
    assert np.array(out.column("at")[0].as_py()).tolist() == list(range(24, 32))
