"""Recall of the line search against the edit similarity alone, without any filter."""

import numpy as np

from quern.llm import line_dedup


def _plain(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_distance():
    draw = np.random.default_rng(0)
    for _ in range(200):
        a, b = ("".join(draw.choice(list("abc"), int(draw.integers(0, 40)))) for _ in range(2))
        d = _plain(a, b)
        for most in (0, 5, 100):
            assert line_dedup._distance(a, b, most) == min(d, most + 1)


def test_lines_alike_by_edits_are_found(spark):
    draw = np.random.default_rng(5)
    word = lambda: "".join(draw.choice(list("etaoinshrdlucmfwygpb"), int(draw.integers(3, 9))))
    rows, pairs = [], []
    for k in range(240):
        words = [word() for _ in range((6, 10, 20, 30, 50, 100)[k % 6])]
        other = list(words)
        other[int(draw.integers(len(words)))] = word()
        a, b = " ".join(words), " ".join(other)
        if line_dedup.alike(a, b):
            pairs.append((2 * k, 2 * k + 1))
        rows += [(2 * k, a), (2 * k + 1, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.report(docs, grams=True).collect() if r.n_removed}
    assert len(pairs) > 200 and gone <= {b for _, b in pairs}
    assert sum(b in gone for _, b in pairs) >= 0.97 * len(pairs)


def test_documents_lose_what_edits_say(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").limit(60).collect()]
    names = list(dict.fromkeys(n for _, t in rows for line in (t or "").split("\n") if (n := line_dedup.normalised(line))))
    links = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and line_dedup.alike(a, b)]
    out = line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string"), grams=True).collect()
    left = {line_dedup.normalised(line) for r in out for line in (r.text or "").split("\n")}
    assert len(links) > 5 and sum(a in left and b in left for a, b in links) <= 0.05 * len(links)


def test_lines_of_the_same_words_meet_in_split_blocks(spark):
    # one SimHash for all of them; each text is like its partner alone, whose last two words are swapped
    draw = np.random.default_rng(3)
    words = ["alpha", "bravo", "delta", "gamma", "hotel", "india", "lemon", "mango", "novel", "ocean", "piano", "queen"]
    orders = [[str(w) for w in draw.permutation(words)] for _ in range(24)]
    lines = [" ".join(x) for o in orders for x in (o, [*o[:-2], o[-1], o[-2]])]
    links = {(a, b) for a in range(48) for b in range(a + 1, 48) if line_dedup.alike(lines[a], lines[b])}
    assert links == {(a, a + 1) for a in range(0, 48, 2)}
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.removed_lines(docs, 5).collect()} == set(range(1, 48, 2))


def test_the_pipeline_compares_rows_of_a_split_block_that_no_forest_links(spark, monkeypatch):
    # one SimHash for the lines of a set; its two short ones share no band, nor a size with the long ones that lead their parts
    import corpus_pipeline

    draw = np.random.default_rng(6)
    sets = [x.split() for x in ("kpcynilk hpxxestm rvcmaznh bdhvzhiw cppnvchu hblzuwhh", "ujdduqgm eiugzsbi iozgetqj smxyisnt jiavnknz vxjrnvso", "jkcekwko hfecbkoc xmwskihe njmervoc etiizslu hdmthyho", "wfbwzppc oauwagzc urqshxmn tibiqfuq rygcikaj zcypyzph")]
    rows = []
    for words in sets:
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " - ".join(words))]
        for _ in range(40):
            rows.append((len(rows), " ".join(str(w) for _ in range(3) for w in draw.permutation(words))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(line_dedup.removed_lines, "__defaults__", (20,))
    left = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert {k for k, text in left.items() if not text} == set(range(1, len(rows), 42))


def test_pairs_worked_out_together_are_those_of_each():
    draw = np.random.default_rng(9)
    left, right = [], []
    for k in range(900):
        size = int(draw.integers(1, (20, 70, 140, 400, 900)[k % 5]))
        a = list(draw.choice(list("ab é木🙂cdefgh"), size))
        b = list(a)
        for _ in range(int(draw.integers(0, max(1, size * 2 // 5) + 1))):
            i = int(draw.integers(0, len(b) + 1))
            b[i : i + int(draw.integers(0, 2))] = list(draw.choice(list("ab é木🙂xyz"), int(draw.integers(0, 2))))
        left.append("".join(a))
        right.append("".join(b))
    want = [line_dedup._distance(a, b, 10**6) for a, b in zip(left, right, strict=True)]
    full = [i for i in range(900) if left[i] and right[i]]
    for step in (0, 1):  # at the distance, and one below it
        most = np.array([want[i] - step for i in full])
        a, b = [left[i] for i in full], [right[i] for i in full]
        # lanes of other lengths and limits beside it; a limit is at least the difference of the lengths
        fair = np.maximum(most, [abs(len(x) - len(y)) for x, y in zip(a, b, strict=True)])
        assert (line_dedup._within(a, b, fair) == (np.array([want[i] for i in full]) <= fair)).all()
    got = line_dedup.all_alike(left, right)
    assert got.tolist() == [line_dedup.alike(a, b) for a, b in zip(left, right, strict=True)]
    assert 100 < got.sum() < 800


def test_pairs_that_are_far_apart_are_left_out_early(monkeypatch):
    draw = np.random.default_rng(4)
    left = ["".join(draw.choice(list("abcdefghijkl "), 400)) for _ in range(200)]
    right = ["".join(draw.choice(list("abcdefghijkl "), 400)) if k % 4 else x[:200] + "z" + x[200:399] for k, x in enumerate(left)]
    lanes, own = [], line_dedup._least
    monkeypatch.setattr(line_dedup, "_least", lambda *args: lanes.append(args[0].shape[1]) or own(*args))
    got = line_dedup._within(left, right, np.full(200, 80))
    assert got.tolist() == [k % 4 == 0 for k in range(200)]
    assert lanes[0] == 200 and lanes[-1] == 50


def test_a_line_that_comes_again_is_sketched_once(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"dk": [1, 2], "text": ["One line of words.\n\nAnother line.", "another LINE.\none  line of words.\nNew."]})
    (out,) = line_dedup._lines(iter([batch]), "grams")
    assert out.column("line").to_pylist() == [0, 2, 0, 1, 2]
    assert [x is None for x in out.column("s0").to_pylist()] == [False, False, True, True, False]
    docs = spark.createDataFrame([(1, "One line of words.\n\nAnother line."), (2, "another LINE.\none  line of words.\nNew.")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.report(docs, grams=True).collect()} == {1: "One line of words.\n\nAnother line.", 2: "New."}


def test_arrays_of_a_step_stay_small(monkeypatch):
    import pyarrow as pa

    draw = np.random.default_rng(12)
    text = lambda k: "\n".join(" ".join(str(x) for x in draw.integers(0, 10**6, 12)) for _ in range(k % 4))
    batch = pa.RecordBatch.from_pydict({"dk": list(range(1000)), "text": [text(k) for k in range(1000)]})
    sizes, own, grams, minima = [], line_dedup.simhashes, [], line_dedup.long_minima
    monkeypatch.setattr(line_dedup, "long_minima", lambda lines, *more: grams.append(len(lines)) or minima(lines, *more))
    monkeypatch.setattr(line_dedup, "simhashes", lambda lines: sizes.append(len(lines)) or own(lines))
    out = list(line_dedup._lines(iter([batch]), "grams"))
    assert max(sizes) <= 150 and sum(sizes) == 1500
    assert max(grams, default=0) <= 150
    assert [x for b in out for x in b.column("dk").to_pylist()] == [k for k in range(1000) for _ in range(k % 4)]
    names = line_dedup._hashes([x for k in range(1000) for x in line_dedup._lines_of(batch.column("text")[k].as_py()) if x])
    assert (np.concatenate([np.stack([b.column(c).to_numpy() for c in ("h0", "h1")], axis=1) for b in out]) == names).all()
    left = ["".join(draw.choice(list("abcdefghijklmnopqrst"), 640)) for _ in range(3000)]
    right = [x[::-1] for x in left]
    tables, within = [], line_dedup._within
    monkeypatch.setattr(line_dedup, "_within", lambda a, b, most: tables.append(len(a) * 21 * 10) or within(a, b, most))
    assert not line_dedup.all_alike(left, right).any()
    assert max(tables) <= 1 << 20
