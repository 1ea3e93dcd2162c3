"""The operators against brute force on small tables that hold nulls, empty and odd texts, ties, repeats and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engram.llm import chat, components, decontaminate, line_dedup, mixing, neural_lm, ngram_join, order_minhash, packed, suffix_dedup, suffix_sort, textops, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def frame(spark, rows, schema=SCHEMA):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, schema).repartition(3).withColumns({"n": F.lit("x"), "line": F.lit(1), "size": F.lit("s"), "word": F.lit(None).cast("string")})


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_word_kernel():
    texts = ["The  cat\tTHE", None, "", " é x\n", "the"]
    data, offs = textops.text_buffers(pa.array(texts))
    h, rows, starts, ends = textops.words(data, offs)
    assert rows.tolist() == [0, 0, 0, 3, 3, 4] and h[0] == h[2] == h[5]
    assert bytes(data[starts[3] : ends[3]]).decode() == "é"
    grams, owner, _ = textops.shingles(*textops.words(*textops.text_buffers(pa.array(["a b c d e f", "a b", "a  B", "b a"])))[:2], 4)
    assert Counter(owner.tolist()) == {0: 2, 1: 1, 2: 1, 3: 1}
    by = dict(zip(owner[-3:].tolist(), grams[-3:].tolist(), strict=True))
    assert by[1] == by[2] != by[3]


# 1


def test_leaks(spark):
    docs = [
        (1, "intro here. Then Alice Smith sold 35 apples to Bob for 12 dollars and then Alice went home with 3 bags."),
        (2, "x Then Carol Jones sold 77 apples to Dan for 99 dollars and then Carol went home with 8 bags. More"),
        (3, "x Then Carol Jones sold 77 apples to Dan for 99 dollars and then Dan went home with 8 bags. More"),
        (4, None), (5, ""), (6, "nothing to see in this text, which is clean and long enough for some windows"), (None, "short one"), (8, "it says a short one here"),
    ]
    items = [(1, "Then Alice Smith sold 35 apples to Bob for 12 dollars and then Alice went home with 3 bags."), (2, "a short one"), (3, None), (4, "")]
    out = got(decontaminate.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")), "doc_id", "item_id", "exact")
    assert out == [(1, 1, True), (2, 1, False), (8, 2, True)]
    kept = decontaminate.clean(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 6, None} and kept.columns == frame(spark, docs).columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(frame(spark, docs), none).count() == 0
    assert decontaminate.leaks(spark.createDataFrame([], SCHEMA), none).count() == 0


ITEMS = "item_id long, text string"


def leaked(spark, texts, items):
    out = decontaminate.leaks(frame(spark, list(enumerate(texts))), spark.createDataFrame(list(enumerate(items)), ITEMS))
    return {(r["doc_id"], r["item_id"]) for r in out.collect()}


def test_leaks_of_edited_and_partial_copies(spark):
    items = [[f"w{chr(97 + k)}{chr(97 + j)}" for j in range(n)] for k, n in enumerate((14, 20, 24, 30))]
    one = lambda w, *at: " ".join("other" if j in at else x for j, x in enumerate(w))
    texts = [one(items[0], 7), one(items[1], 10), one(items[2], 8, 16), " ".join(["so", *items[3][6:24], "on"]), " ".join(items[3][:7])]
    assert leaked(spark, texts, [" ".join(w) for w in items]) == {(k, k) for k in range(4)}
    dense = "the quick cook bakes some fresh bread today " + " ".join(f"{k} km" for k in range(20, 32))
    again = "the quick cook bakes some fresh bread today " + " ".join(f"{k} km" for k in range(50, 62))
    assert leaked(spark, [again], [dense]) == {(0, 0)}


def test_leaks_of_items_dense_in_slots(spark):
    items = ["What Every Good Cook Should Know About Bread And Butter", "12 km 30 kg 45 s 7 mm 81 % 9 GB", "Zebra", "Alice Smith"]
    texts = [f"so I read {x} and more" for x in items] + ["Nothing Of This Is What Every Cook Should Say"]
    assert leaked(spark, texts, items) == {(k, k) for k in range(4)}


def test_leaks_with_numbers_and_names_changed_apart(spark):
    items = [
        "a farmer keeps 3 hens in one yard and then buys 5 more from the market so how many are there",
        "a shop sells 5 apples at a price of 5 dollars and the buyer pays with a large note today",
        "the old teacher Alice walks to the quiet library every morning and reads a long book until Alice goes home for dinner with the children",
    ]
    texts = [items[0].replace("3", "4").replace("5", "4"), items[1].replace("5 apples", "3 apples").replace("5 dollars", "7 dollars"), items[2].replace("until Alice", "until Carol")]
    assert leaked(spark, texts, items) == {(k, k) for k in range(3)}


# 2


def lines_by_hand(rows, t):
    lines = sorted(((i, k, frozenset(words(x))) for i, text in rows if text is not None for k, x in enumerate(text.split("\n"))), key=lambda z: z[:2])
    gone = set()
    for a, (i, k, s) in enumerate(lines):
        if s and any(q and (100 + t) * len(s & q) >= t * (len(s) + len(q)) for _, _, q in lines[:a]):
            gone.add((i, k))
    out = []
    for i, text in rows:
        parts = [] if text is None else text.split("\n")
        left = [x for k, x in enumerate(parts) if (i, k) not in gone]
        out.append((i, len(parts), len(parts) - len(left), None if text is None else "\n".join(left)))
    return sorted(out, key=str)


@pytest.mark.parametrize("steps, candidates", [(2048, 32), (1, 1), (2, 3)])
def test_lines(spark, steps, candidates):
    rnd = random.Random(2)
    vocabulary = [f"w{int(rnd.random() ** 3 * 60)}" for _ in range(300)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(1, 25))] for _ in range(20)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(rnd.randint(0, 5)):
            b = list(rnd.choice(base)) if rnd.random() < 0.7 else [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 20))]
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3]) if b else 0):
                b[rnd.randrange(len(b))] = rnd.choice(vocabulary)
            text.append(" ".join(b))
        rows.append((i, "\n".join(text)))
    rows += [(900, None), (901, ""), (902, " \n\n"), (903, "A b"), (904, "b  a")]
    out = line_dedup.remove_lines(frame(spark, rows), 80, steps, candidates)
    assert got(out, "doc_id", "n_lines", "n_removed", "kept") == lines_by_hand(rows, 80)


def test_lines_of_repeated_rows(spark):
    rows = [(1, "one line of words"), (1, "one line of words"), (None, "Words of one line")]
    out = got(line_dedup.clean(frame(spark, rows)), "doc_id", "text")
    assert out == sorted([(None, "Words of one line"), (1, ""), (1, "")], key=str)
    assert line_dedup.remove_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lines_with_clashing_columns_and_few_rows(spark):
    for rows in ([(1, "a")], [(1, None)], [(1, "")], [(1, "x y\nx y"), (2, "y x")], [(1, "\n\n"), (2, "last\n"), (3, "last\nb"), (0, "b\nlast")]):
        docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("lines", "kept", "row", "n_lines", "n_removed", "part", "c0", "same")})
        out = line_dedup.clean(docs)
        assert out.columns == docs.columns and all(r["kept"] == "kept" and r["row"] == "row" for r in out.collect())
        assert got(out, "doc_id", "text") == sorted(((i, t) for i, _, _, t in lines_by_hand(rows, 80)), key=str)


def test_lines_of_long_texts_and_many_like_lines(spark):
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(40)]
    like = lambda: " ".join(x if rnd.random() > 0.06 else f"v{rnd.randrange(50)}" for x in base)
    rows = [(i, "\n".join([f"head {i} of this", *(like() for _ in range(3))])) for i in range(60)]
    rows += [(100, "\n".join(f"line {rnd.randrange(30_000)} {rnd.randrange(9)} of a long text" for _ in range(20_000))), (101, "z" * 400_000), (102, "z" * 400_000)]
    rows[60] = (100, "\n".join(rows[60][1].split("\n")[:600]) + "\n" + " ".join(f"q{k}" for k in range(90_000)))
    for steps, candidates in ((2048, 32), (20, 2)):
        out = line_dedup.remove_lines(frame(spark, rows), 80, steps, candidates)
        assert got(out, "doc_id", "n_lines", "n_removed", "kept") == lines_by_hand(rows, 80)


class Held:
    """What stands for a broadcast value."""

    def __init__(self, value):
        self.value = value


def test_second_pass_sorts_few_lines():
    class Counting(line_dedup.Order):
        placed = 0

        def place(self, hashes):
            Counting.placed += len(hashes)
            return super().place(hashes)

    texts = [f"Line {k} of some\n\n common words {k % 7}\nRare{k} word" for k in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(range(200)), pa.array(texts)], ["row", "doc_id", "text"])
    order = Counting(np.full(1 << line_dedup.RANK_BITS, 2))
    data, offs = textops.text_buffers(batch.column(2))
    row, line, size, start, words = line_dedup.line_sets(data, offs, order)
    picked = np.flatnonzero((line == 3) & (row % 50 == 0))  # Rare0, Rare50, Rare100, Rare150
    rare = textops.words(*textops.text_buffers(pa.array([f"rare{k}" for k in row[picked]])))[0]
    marks = np.zeros((2, line_dedup.MARKS // 8), dtype=np.uint8)
    for kind, values in enumerate((line_dedup.identity(words, start, size)[picked], order.place(rare))):
        at = (values % np.uint64(line_dedup.MARKS)).astype(np.int64)
        np.bitwise_or.at(marks[kind], at >> 3, (1 << (at & 7)).astype(np.uint8))
    Counting.placed = 0
    made = list(line_dedup._lines(Held(order), 50, 1, 4, Held(marks))(iter([batch])))
    posted = [(r, k) for b in made for x in b.to_pylist() for r, k in zip(packed.numbers(x["row"], np.int64), packed.numbers(x["line"], np.int32), strict=True)]
    assert {(0, 3), (50, 3), (100, 3), (150, 3)} >= set(posted) and posted
    assert Counting.placed <= 16  # of 1800 words


def test_texts_are_not_sorted_to_find_lines(spark):
    texts = spark.createDataFrame([(k, f"a b\nc {k}") for k in range(9)], "row long, text string")
    lines = spark.createDataFrame([(3, 1), (5, 0), (5, 1)], "row long, line int")
    shared = spark.sparkContext.broadcast(line_dedup.Order(np.full(1 << line_dedup.RANK_BITS, 2)))
    found = line_dedup._sets_of(texts, shared, lines, 4)
    assert "ShuffledHashJoin" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "SortMergeJoin" not in plan
    assert sorted((r["row"], r["line"], len(r["words"])) for r in found.collect()) == [(3, 1, 2), (5, 0, 2), (5, 1, 2)]


def test_kept_text_of_lines():
    texts = ["a\nb\nc", None, "", "x", "\n\ny\n", "é\nü\n", "p\nq"]
    lines = [[1], None, None, [0], [2, 3], [1, 2], None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(lines, pa.list_(pa.int32()))], ["text", "lines"])
    (out,) = line_dedup._removal(iter([batch]))
    out.validate(full=True)
    left = [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in (gone or ())) for t, gone in zip(texts, lines, strict=True)]
    assert out.column("kept").to_pylist() == left


def test_words_of_consecutive_texts():
    texts = ["", "Ab", "cD e", "", "\x1cé\x08 [@Z`{\t", " ", "x\x0b\x0cy\r"]
    data, offs = textops.text_buffers(pa.array(texts))
    hashes, rows, starts, ends = textops.words(data, offs)
    found = [(r, bytes(data[i:j])) for r, i, j in zip(rows.tolist(), starts, ends, strict=True)]
    assert found == [(k, w.encode()) for k, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    alone = [textops.words(*textops.text_buffers(pa.array([lower(w.decode())])))[0][0] for _, w in found]
    assert hashes.tolist() == alone


# 3


def plain_fingerprint(text):
    """The definition, by plain loops over one text."""
    k, m = order_minhash.K, order_minhash.SIGNATURES
    if not text:
        return [0] * m
    grams = [text[i : i + k] for i in range(max(1, len(text) - k + 1))]
    seen, places = Counter(), []
    for i, g in enumerate(grams):
        codes = np.array([ord(c) for c in g], dtype=np.uint64)
        power, _ = textops._powers(len(codes) + 1)
        h = textops.mix(np.array([((codes + np.uint64(1)) * power[: len(codes)]).sum(dtype=np.uint64)], dtype=np.uint64))
        spot = textops.mix((h >> np.uint64(24)) * np.uint64(0x9FB21C651E98DF25) + np.uint64(seen[g]) * np.uint64(0xD6E8FEB86659FD93))
        seen[g] += 1
        places.append((int(spot[0]) >> 36, i, h))
    places.sort(key=lambda p: p[:2])
    out = []
    for b in range(m):
        first = next((j for j, p in enumerate(places) if p[0] >= b << 22), len(places))
        chosen = sorted((places[(first + j) % len(places)] for j in range(order_minhash.PICKED)), key=lambda p: p[1])
        s = np.zeros(1, dtype=np.uint64)
        for _, _, h in chosen:
            s = textops.mix(s * np.uint64(0x9E3779B97F4A7C15) + h)
        out.append(int(s[0] >> np.uint64(48)))
    return out


def test_fingerprints():
    rnd = random.Random(4)
    texts = ["", "a", "abcdefg", "abcdefgh", "aaaaaaaaaaaaaaaaaaaaaaaa", "Zoë 漢字 🙂 " * 9, *("".join(rnd.choice("abcé ") for _ in range(rnd.randint(5, 900))) for _ in range(12))]
    out = order_minhash.fingerprints(texts)
    assert [x.tolist() for x in out] == [plain_fingerprint(t) for t in texts]
    assert (order_minhash.fingerprints(texts[::-1])[::-1] == out).all()
    long = "".join(rnd.choice("abcdefgh") for _ in range(20_000))
    edits = long[:10_000] + "x" + long[10_001:]
    moved = long[10_000:] + long[:10_000]
    near, far = (float(order_minhash.likeness(*order_minhash.fingerprints([long, other]))) for other in (edits, moved))
    assert near > 0.95 and far < near  # the same k-mers in another order are less alike


@pytest.mark.parametrize("kept", [1, 4, 8])
def test_fingerprints_of_long_texts(monkeypatch, kept):
    """Whether the k-mers near the points suffice or all of a text must be looked at, the picked ones are the same."""
    rnd = random.Random(kept)
    texts = ["".join(rnd.choice("abc ") for _ in range(rnd.randint(600, 4000))) for _ in range(30)]
    monkeypatch.setattr(order_minhash, "KEPT", kept)
    assert [x.tolist() for x in order_minhash.fingerprints(texts)] == [plain_fingerprint(t) for t in texts]


def test_edited(spark):
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(2500)] + [(5000, None), (None, "has no place"), (None, None)]
    out = {r["doc_id"]: r for r in order_minhash.compare_edited(frame(spark, rows)).collect()}
    order = sorted((i for i, _ in rows if i is not None), reverse=True)
    texts = {i: t or "" for i, t in rows if i is not None} | {None: ""}
    assert order_minhash.compare_edited(frame(spark, rows)).count() == 2503
    nulls = order_minhash.compare_edited(frame(spark, rows)).where("doc_id IS NULL").collect()
    assert sorted((r["n_chars"], r["edited_sha256"]) for r in nulls) == sorted((len(t), hashlib.sha256(order_minhash.edited(t, f).encode()).hexdigest()) for t, f in (("", "has no place"), ("has no place", "")))
    for a, b in zip(order, [*order[1:], None], strict=True):  # the nulls, the empty one first, come behind the smallest
        edited = order_minhash.edited(texts[a], texts[b])
        assert out[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and out[a]["n_chars"] == len(texts[a])
        if a % 97 == 0:
            p = order_minhash.fingerprints([texts[a], edited, texts[b]])
            assert out[a]["near_edited"] == (p[0] == p[1]).mean() and out[a]["near_next"] == (p[0] == p[2]).mean()
            assert out[a]["fingerprint"] == p[0].astype(">u2").tobytes().hex()
    for alone in ([(7, "abc" * 9)], [(None, "abc" * 9)]):
        one = order_minhash.compare_edited(frame(spark, alone)).collect()
        assert len(one) == 1 and one[0]["near_next"] == 1
    assert order_minhash.compare_edited(frame(spark, [(None, "a"), (None, "b"), (None, "b")])).count() == 3
    assert order_minhash.compare_edited(spark.createDataFrame([], SCHEMA)).count() == 0


# 4


def test_suffix_arrays():
    rnd = random.Random(3)
    for _ in range(300):
        n, k = rnd.randint(1, 60), rnd.choice([2, 3, 5, 250])
        t = np.array([rnd.randint(1, k) if rnd.random() < 0.9 else 1 for _ in range(n)] + [0])
        s = t.tolist()
        assert suffix_sort.suffix_array(t, int(t.max()) + 1).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_arrays_recurse(monkeypatch):
    """The string of names is sorted by induction again, level by level."""
    depths = []
    plain = suffix_sort.suffix_array
    monkeypatch.setattr(suffix_sort, "suffix_array", lambda t, kinds: depths.append(len(t)) or plain(t, kinds))
    a, b = [1], [1, 2]
    while len(b) < 3000:  # a Fibonacci word, full of repeats
        a, b = b, b + a
    t = np.array([*b, 0])
    s = bytes(t.tolist())
    assert suffix_sort.suffix_array(t, 3).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    assert len(depths) > 3 and depths == sorted(depths, reverse=True)


def removed_by_hand(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length, gram, hot", [(20, 8, 1 << 26), (12, 12, 1 << 26), (20, 8, 100)])
def test_repeats(spark, length, gram, hot):
    rnd = random.Random(5)
    piece = lambda: "".join(rnd.choice("abé ") for _ in range(rnd.randint(0, 60)))
    base = [piece() for _ in range(12)]
    rows = [(i, rnd.choice(base) + piece() + rnd.choice(base)) for i in range(60)] + [(100, None), (101, ""), (102, "a" * 90), (103, base[0] * 3), (103, base[0] * 3), (None, base[1] * 2)]
    rows += [(110 + i, piece() + base[2][:14] + piece()) for i in range(30)] + [(200, "".join(rnd.choice("ab") for _ in range(700)))]
    out = suffix_dedup.remove_repeats(frame(spark, rows), length, gram, 500, hot_bytes=hot, piece=100)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed_by_hand(rows, length)
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA), length, gram).count() == 0


# 5


def test_language_model(spark):
    rnd = random.Random(6)
    pairs = {f"a{i}": f"b{i}" for i in range(30)}
    rows = [(i, " ".join(f"{a} {pairs[a]}" for a in rnd.choices(list(pairs), k=30)) + f" rare{i}") for i in range(400)] + [(900, None), (901, ""), (902, "A1 unseenword"), (None, "b1")]
    out = {r["doc_id"]: r for r in neural_lm.score_documents(frame(spark, rows)).collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    total, distinct = sum(counts.values()), len(counts)
    for i, t in rows:
        own = [*words(t), None]
        r = out[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(own), sum(counts[w] > 0 for w in own), total)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own))
    told = [r for r in out.values() if r["held_out"]]
    assert sum(r["score"] for r in told) > sum(r["base_score"] for r in told)
    assert neural_lm.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    noise = np.array([0.7, 0.2, 0.1])
    table = np.array([[80, 1, 9], [10, 80, 1], [5, 5, 90]], dtype=np.float32)
    p = 10.0 ** neural_lm.log_probabilities(neural_lm.train(table, noise, 300))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4) and np.abs(p - table / table.sum(axis=1, keepdims=True)).max() < 0.06


# 6


def linked_by_hand(rows):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a][1] & sets[b][1])
            if common and 100 * common >= 75 * len(sets[a][1] | sets[b][1]):
                top[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets)), key=str)


def test_ngram_join(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{k}" for k in range(200)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(3, 60))] for _ in range(14)]
    passage = [rnd.choice(vocabulary) for _ in range(45)]
    rows = []
    for i in range(200):
        b = list(rnd.choice(base)) if rnd.random() < 0.6 else passage + [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 16))]
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
            b[rnd.randrange(len(b))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(b)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "w1 " * 50), (905, "w1 " * 50)]
    out = ngram_join.join(frame(spark, rows))
    expected = linked_by_hand(rows)
    assert got(out, "doc_id", "n_shingles", "component_id") == expected
    kept = ngram_join.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in expected})
    assert ngram_join.join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ngram_join_of_few_short_texts(spark):
    rnd = random.Random(7)
    pool = ["a b c d e f", "a b c d e f g", "a b c", "c b a", "x y z u v w", "", None, "a b c d e f", "p q r s t u v w x y", "p q r s t u v w x z"]
    cases = [["a b c d e f"], ["a b c", "x y z"], ["a b c", "a b c"], [None], [None, ""], *([rnd.choice(pool) for _ in range(rnd.randint(1, 5))] for _ in range(4))]
    for texts in cases:
        rows = list(enumerate(texts))
        docs = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit("x"), "entity": F.lit(1), "_row": F.lit(2), "kept": F.lit(None).cast("int")})
        expected = linked_by_hand(rows)
        assert got(ngram_join.join(docs), "doc_id", "n_shingles", "component_id") == expected
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in expected}) and {r["row"] for r in kept.collect()} == {"x"}


def test_ngram_join_of_long_and_many_like_texts(spark):
    """Many variants of one text, of which some meet no centre, and a very long one."""
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(220):
        b = list(base)
        for _ in range(rnd.choice([0, 1, 2, 2, 3, 3, 4])):
            b[rnd.randrange(len(b))] = f"v{rnd.randrange(30)}"
        rows.append((i, " ".join(b[rnd.randrange(6) :])))
    rows += [(500, " ".join(f"z{rnd.randrange(900)}" for _ in range(60_000)))]
    rows += [(501, rows[-1][1] + " end")]
    expected = linked_by_hand(rows)
    assert len({c for _, _, c in expected}) > 3
    for per_fragment in (1 << 21, 1000):
        assert got(ngram_join.join(frame(spark, rows), per_fragment=per_fragment), "doc_id", "n_shingles", "component_id") == expected


def test_ngram_join_packs_places_beyond_their_bits(monkeypatch):
    rnd = np.random.default_rng(5)
    x = object.__new__(ngram_join._Fragment)
    x.values, x.place = rnd.integers(0, 50, 600).astype(np.uint64), rnd.integers(0, 40, 600)
    plain = x.runs(np.arange(40))
    monkeypatch.setattr(ngram_join, "_PLACE_BITS", 3)
    assert all((a == b).all() for a, b in zip(plain, x.runs(np.arange(40)), strict=True))


def test_ngram_join_of_like_chunks(spark):
    """Partitions whose smallest and largest sets and whose number of sets are the same, with other sets between."""
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abcdefghij") + str(rnd.randrange(50)) for _ in range(40)) for _ in range(8)]
    texts += [t + " more" for t in texts]
    identity = ngram_join.sets_of(*textops.text_buffers(pa.array(texts)))[2]
    low, high = int(np.argmin(identity)), int(np.argmax(identity))
    inner = [k for k in range(8) if not {k, k + 8} & {low, high}]
    dealt = [low, *inner, high, low, *(k + 8 for k in inner), high]
    rows = [(i, texts[k]) for i, k in enumerate(dealt)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), SCHEMA)
    assert docs.rdd.getNumPartitions() == 2
    assert got(ngram_join.join(docs), "doc_id", "n_shingles", "component_id") == linked_by_hand(rows)


def test_ngram_join_sends_bounded_bytes(spark, monkeypatch):
    """What is sent of an n-gram doesn't grow with the fragments, whose number follows the n-grams that a pass sends."""
    rnd = random.Random(6)
    rows = [(i, " ".join(f"w{rnd.randrange(5000)}" for _ in range(60))) for i in range(400)]
    rows += [(i + 400, t + " more") for i, t in rows[:8]]
    texts = frame(spark, rows).select("text")
    for bits in (4, 8, 12):
        sent = textops.limit_arrow(texts).mapInArrow(ngram_join._send_shared(bits), ngram_join._SHARED)
        size = sum(len(x) for r in sent.collect() for x in r if isinstance(x, bytes | bytearray))
        assert size < 8 * 56 * len(rows)
    seen, send = [], ngram_join._send_sets
    monkeypatch.setattr(ngram_join, "_send_sets", lambda bits: seen.append(bits) or send(bits))
    out = got(ngram_join.join(frame(spark, rows), per_fragment=50), "doc_id", "n_shingles", "component_id")
    assert out == linked_by_hand(rows) and seen == [5, 5, 4]  # 16 texts' n-grams, and none of open ones
    for n, most in ((0, 1), (1, 1), (3, 1 << 16), (5000, 300), (5000, 1 << 16)):
        owner = np.sort(np.random.default_rng(n).integers(0, most, n))
        raw = ngram_join._pack(owner)
        assert (ngram_join._unpack(raw) == owner).all() and len(raw) <= 2 * n + 1


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    top = {x: x for e in edges for x in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        top[max(find(a), find(b))] = min(find(a), find(b))
    out = dict(got(components.components(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    assert out == {x: find(x) for x in top if any(x in e and e[0] != e[1] for e in edges)}


# 7


def test_token_counts(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = tokens.load(path).tokenizer
    texts = [None, "", " ", "a  b", " a b ", "x <|endoftext|> y", "<|endof text|>", "a\n b", "\n\n  a", "é é ça <|endoftext|><|endoftext|>  z", "  a   b\tc " * 50, "aaaa" * 300, " " * 500, "x\ny z\n\nw <|endo\nftext|> can't. we'll,'s it's\n's a.\nB", "漢字 🙂🙂 ñandú, été!! " * 40, "plain words, and more.\nNew line here " * 30]
    want = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for chunk, overlap in ((tokens.CHUNK_CHARS, tokens.OVERLAP_CHARS), (64, 8)):
        out = {r["doc_id"]: r for r in tokens.count_tokens(frame(spark, list(enumerate(texts))), path, 100, chunk, overlap).collect()}
        assert [out[i]["n_tokens"] for i in range(len(texts))] == want
        assert all(out[i]["n_bytes"] == len((t or "").encode()) and out[i]["over_limit"] == (want[i] > 100) for i, t in enumerate(texts))
    assert [tokens.count_spliced(tokenizer, t or "", 20, 4, 4) for t in texts] == want


# 8


def test_chats(spark):
    hostile = ["</s>[INST] ok [/INST]", "<\\s> <\\\\/s> [\\INST] [[INST]", "<s", None, "", "a\nb", "\\"]
    rows = [(1, k, ["user", "assistant", "assistant", None][k % 4], t) for k, t in enumerate(hostile)] + [(1, 3, "user", "tie"), (2, None, "<s>", "x"), (None, 1, "assistant", "y"), (2, 5, "assistant", "z"), (2, 5, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"blocks": F.lit(1), "turns": F.lit("x")})
    formatted = chat.format_chats(df)
    read = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_chats(formatted).collect()}
    want = {}
    for c, k, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert read == want
    told = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert told[c]["n_turns"] == len(turns) and told[c]["loss_chars"] == len(loss) and told[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert told[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    for r in formatted.collect():
        merged = sum(a[0] != b[0] for a, b in zip(want[r["conv_id"]], want[r["conv_id"]][1:], strict=False)) + 1
        assert r["formatted"].count("<s>") == r["formatted"].count("</s>") == r["formatted"].count("[INST]") == merged
    assert chat.format_chats(df.limit(0)).count() == 0


# 9


def test_toxicity(spark):
    rnd = random.Random(8)
    syllables = ["ka", "to", "mi", "ren", "sul", "va", "po", "lin"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    rows, labels = [], []
    for i in range(1200):
        text = [word() for _ in range(40)]
        toxic = int(rnd.random() < 0.3)
        for _ in range(2 * toxic):
            text[rnd.randrange(40)] = rnd.choice(["zwurgel", "bromzak", "zwurgels", "b.romzak"])
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    rows += [(5000, None), (5001, ""), (5002, "z w u r g e l bro-mzak ka to zwuurgel")]
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.classify(frame(spark, rows), marked).collect()}
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values())
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i]["held_out"] for i, _ in held)
    assert np.mean([out[i]["predicted"] == y for i, y in held]) > 0.97
    assert out[5002]["predicted"] == 1 and out[5000]["predicted"] == 0
    clashing = frame(spark, rows).withColumns({"score": F.lit("s"), "toxic": F.lit(2), "bytes": F.lit(1), "_id": F.lit("i")})
    kept = toxicity.clean(clashing, marked)
    assert kept.columns == clashing.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if not r["predicted"]}
    none = toxicity.classify(frame(spark, rows[:5]), marked.limit(0)).collect()
    assert len(none) == 5
    assert toxicity.classify(spark.createDataFrame([], SCHEMA), marked).count() == 0


def test_string_kernel():
    """The folded machine gives the kernel expansion over triples within the span, by plain loops."""
    def triples(w):
        out = Counter()
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    if all(c.isalpha() for c in (w[i], w[j], w[k])):
                        out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    a, b = "idiot", "id-iott"
    raw = np.frombuffer((a + b).encode(), dtype=np.uint8)
    args = toxicity.encode_words(raw, np.array([0, 5]), np.array([5, 12]))
    kernel = toxicity._features(*args, toxicity._vectors(*args))
    x, y = triples(a), triples(b)
    norms = toxicity._NORM[[5, 6]]
    assert kernel[0, 1] == pytest.approx(sum(x[t] * y[t] for t in x) / norms[0] / norms[1], rel=1e-5)


def test_machine_is_the_expansion_over_landmarks():
    """A word's decision value is the weighted sum of its kernels with the landmarks, whatever the blocks."""
    rnd = np.random.default_rng(4)
    words = ["".join(chr(97 + x) for x in rnd.integers(0, 8, rnd.integers(1, 30))) for _ in range(60)] + ["a-b.c", "zé-ñz"]
    raw = "".join(words).encode()
    ends = np.cumsum([len(w.encode()) for w in words])
    args = toxicity.encode_words(np.frombuffer(raw, dtype=np.uint8), np.append(0, ends[:-1]), ends)
    vectors, weights = toxicity._vectors(*args)[:, :9], rnd.normal(size=9)
    kernels = toxicity._features(*args, vectors)
    folded = toxicity.decision(*args, (vectors @ weights).astype(np.float32), 0.25)
    assert np.allclose(folded, kernels @ weights + 0.25, atol=1e-4)
    block, toxicity._BLOCK = toxicity._BLOCK, 7
    try:
        assert np.allclose(toxicity._features(*args, vectors), kernels, atol=1e-6)
    finally:
        toxicity._BLOCK = block


# 10


def test_targets(spark):
    rnd = random.Random(9)
    for sizes in ([5, 5, 5], [1, 100, 3, 7, 0, 50], [rnd.randint(0, 40) for _ in range(17)], [9]):
        names = [f"s{i:02d}" for i in range(len(sizes) - 1)] + [None]
        out = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")).collect()}
        weights, full = [(5, 2, 1)[i % 3] for i in range(len(sizes))], set()
        while True:
            left, sharing = sum(sizes) - sum(3 * sizes[i] for i in full), sum(w for i, w in enumerate(weights) if i not in full)
            want = [3 * s if i in full else left * weights[i] / sharing for i, s in enumerate(sizes)]
            more = {i for i, s in enumerate(sizes) if want[i] > 3 * s + 1e-9}
            if not more:
                break
            full |= more
        assert [out[n] for n in names] == pytest.approx(want)


def test_mix(spark):
    rnd = random.Random(10)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 30)), rnd.choice(["a", "b", "c", None])) for i in range(300)] + [(400, None, "a"), (401, "", "d"), (7, "x y", "a"), (7, "x y", "a")]
    df = frame(spark, rows, "doc_id long, text string, source string")
    out = [r.asDict() for r in mixing.mix(df, bucket_rows=20).collect()]
    again = [r.asDict() for r in mixing.mix(df.repartition(7), bucket_rows=50).collect()]
    by = lambda rs: {s: sum(r["taken"] for r in rs if r["source"] == s) for s in ("a", "b", "c", "d", None)}
    assert by(out) == by(again)
    goal = {r["source"]: r["target"] for r in out}
    assert all(0 <= goal[s] - n < 1 for s, n in by(out).items())
    assert sorted((r["doc_id"], r["copy"], r["taken"]) for r in out) == sorted((r["doc_id"], r["copy"], r["taken"]) for r in again)
    assert all(0 <= r["taken"] <= r["size"] and r["copy"] < 3 for r in out)
    end = 0
    for r in sorted((r for r in out if r["taken"]), key=lambda r: r["position"]):
        assert r["position"] == end
        end += r["taken"]
    finishes = [r["finish"] for r in sorted((r for r in out if r["taken"]), key=lambda r: r["position"])]
    assert finishes == sorted(finishes)
    assert mixing.mix(df.limit(0)).count() == 0
    assert sum(r["taken"] for r in mixing.taken_per_document(mixing.mix(df)).collect()) == end


def test_ngram_join_reads_one_of_equal_texts(spark, monkeypatch):
    """Copies in other tasks are no texts of their own: nothing of them is sent to the later passes, unless they share a doc_id or have none."""
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(60)]
    near = texts[0].rsplit(" ", 1)[0] + " other"  # links with the first text and its copies
    rows = [(100 * k + i if i != 7 else None, t) for k in range(4) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize([*rows, (999, near)], 4), "doc_id long, text string")
    steps = {}

    def keep(df, name, write=ngram_join.materialise):
        steps[name] = write(df, name)
        return steps[name]

    monkeypatch.setattr(ngram_join, "materialise", keep)
    out = {(r["doc_id"], r["component_id"]) for r in ngram_join.join(docs).collect()}
    assert steps["alive"].count() == 3  # the two that are near each other, and the one without doc_id
    assert out == {(100 * k + i, i) for k in range(4) for i in range(60) if i != 7} | {(None, None), (999, 0)}
