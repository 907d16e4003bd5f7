import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex

from simquarry.llm import decontaminate as de
from simquarry.llm.queries import op4_decontamination

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string"
WORDS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[\p{L}\p{N}\p{M}--[\p{Han}\p{Hiragana}\p{Katakana}]]+", regex.V1)


def plain_words(text):
    return WORDS.findall(regex.sub("[\u00ad\u200b-\u200d\u2060\ufeff]", "", (text or "").lower()))


def trigrams(w):
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute(docs, items, threshold=de.THRESHOLD):
    """{(document, item): best (score, question, answer)} by the definition, one passage and one
    item after the other."""
    items = [(i, t, Counter(plain_words(t))) for i, t in dict.fromkeys(items) if plain_words(t)]
    df = Counter(w for _, _, c in items for w in c)
    mean = sum(sum(c.values()) for _, _, c in items) / max(1, len(items))
    out = {}
    for number, (_, text) in enumerate(docs):
        w = plain_words(text)
        for item, t, c in items:
            n = sum(c.values())
            half = de.HALF
            while half < n:
                half *= 2
            weight = {x: math.log(1 + (len(items) - df[x] + 0.5) / (df[x] + 0.5)) * k * (de.K1 + 1) / (k + de.K1 * (1 - de.BB + de.BB * n / mean)) for x, k in c.items()}
            total = sum(weight.values())
            if sum(weight[x] for x in set(w) & set(weight)) / total < threshold - 1e-9:
                continue
            sentences = [s for s in map(plain_words, regex.split(r"(?<=[.!?…])\s+|(?<=[。！？])|\n+", t)) if s]
            if len(sentences) > 1:
                question, answer = [x for s in sentences[:-1] for x in s], sentences[-1]
            else:
                cut = n - n // 3
                question, answer = plain_words(t)[:cut], plain_words(t)[cut:]
            for a in range(0, max(1, len(w) - half), half):
                p = w[a : a + 2 * half]
                score = sum(weight[x] for x in set(p) & set(weight)) / total
                if score < threshold - 1e-9:
                    continue

                def share(part, p=p):
                    g = trigrams(part)
                    return sum(any(tuple(p[i : i + len(x)]) == x for i in range(len(p) - len(x) + 1)) for x in g) / len(g) if g else 1.0

                q, r, whole = share(question), share(answer), share(plain_words(t))
                if q >= de.QUESTION and r >= de.ANSWER or whole >= de.WHOLE:
                    out[number, item] = max(out.get((number, item), (0, 0, 0)), (score, q, r))
    return {(docs[k][0], i): v for (k, i), v in out.items()}


def test_query_on_the_table(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in op4_decontamination(spark, data).collect()}
    want = brute(docs, items)
    assert set(got) == set(want) and got and all(got[k] == pytest.approx(want[k]) for k in got)


def find(spark, docs, items, clean=False):
    df, bench = spark.createDataFrame([(*d, "") for d in docs], DOCS), spark.createDataFrame(items, ITEMS)
    if clean:
        return {r.doc_id for r in de.decontaminated(df, bench).collect()}
    return {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in de.find_leaks(df, bench).collect()}


@pytest.mark.parametrize("cut", [False, True])
def test_equals_brute_force(spark, monkeypatch, cut):
    """Items of several length classes, whole, shortened and spread; in one index or many."""
    rng = random.Random(3)
    if cut:
        monkeypatch.setattr(de, "INDEX_BYTES", 700)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([5, 30, 60, 90, 150]))) + "? " + " ".join(rng.choices(vocab, k=4)) + ".") for i in range(24)]
    noise = lambda n: " ".join(rng.choices(vocab, k=n))
    docs = [f"{noise(30)} {t} {noise(200)}" for _, t in items]
    docs += [f"{noise(30)} {' '.join(t.split()[: -rng.randrange(1, 12)])} {noise(30)}" for _, t in items]
    docs += [t.replace("? ", f" {noise(60)} ") for _, t in items]
    docs = list(enumerate(docs))
    got, want = find(spark, docs, items), brute(docs, items)
    assert set(got) == set(want) and len(got) > 30 and all(got[k] == pytest.approx(want[k]) for k in got)
    assert find(spark, docs, items, clean=True) == {i for i, _ in docs} - {i for i, _ in want}


def test_a_long_item_changes_no_other(spark):
    question, answer = "what colour is the old harbour bridge at dawn in june", "it is painted a deep and quiet green"
    far = " ".join(f"w{i}" for i in range(1200))
    docs = [(1, f"{question}? {far} {answer}."), (2, f"{far} {question}? {answer}.")]
    item = (10, f"{question}? {answer}.")
    others = [(20 + k, " ".join(f"x{k}y{i}" for i in range(9))) for k in range(30)]
    longer = (99, " ".join(f"long{i}" for i in range(3000)))
    assert {k for k in find(spark, docs, [item, *others])} == {(2, 10)} == {k for k in find(spark, docs, [item, *others, longer])}


@pytest.mark.parametrize("change", [lambda t: t.replace(" ", "\u00a0"), lambda t: t.replace(" ", "—"), lambda t: " ".join(f"“{w}”" for w in t.split()), lambda t: t.replace("e", "e\u00ad"), str.upper, lambda t: t.replace(" ", "_")])
def test_marks_part_words(spark, change):
    item = (7, "What colour is the old harbour bridge at dawn? It is painted a deep and quiet green.")
    others = [(20 + k, " ".join(f"x{k}y{i}" for i in range(9))) for k in range(50)]
    assert set(find(spark, [(1, f"So: {change(item[1])} indeed"), (2, "So indeed")], [item, *others])) == {(1, 7)}


def test_scripts_without_spaces(spark):
    item = (7, "秋の夜に月を見る人は誰ですか。それは遠い国から来た旅人です。")
    docs = [(1, f"昔々{item[1]}と書いた。"), (2, "昔々ある所に。")]
    assert set(find(spark, docs, [item, (8, "山の上の古い寺")])) == {(1, 7)}


def test_edge_cases(spark):
    q = "What colour is the old harbour bridge at dawn? It is painted a deep and quiet green."
    filler = " ".join(f"word{i}" for i in range(40_000))
    docs = [(1, q, ""), (2, f"{filler} {q.upper().replace('?', ' !!')} {filler}", ""), (3, None, ""), (4, "", ""), (5, "What colour is the old harbour bridge at dawn?", ""), (None, q, ""), (1, q, ""), (6, filler, ""), (7, q.replace("deep", "pale"), ""), (8, "Élan vital", "")]
    items = [(10, q), (10, q), (11, None), (12, ""), (13, "?!"), (None, "ÉLAN VITAL")]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = sorted(((r.doc_id, r.item_id) for r in de.find_leaks(df, bench).collect()), key=str)
    assert got == sorted([(1, 10), (1, 10), (2, 10), (None, 10), (7, 10), (8, None)], key=str)
    clean = de.decontaminated(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {3, 4, 5, 6}
    assert de.find_leaks(df.limit(0), bench).count() == 0 and de.find_leaks(df, bench.limit(0)).count() == 0


def test_steps_change_nothing(monkeypatch):
    rng = random.Random(7)
    texts = pa.array([" ".join(rng.choices([f"v{i}" for i in range(70)], k=rng.choice([0, 3, 40, 900]))) for _ in range(30)])
    _, h, row, _, _ = de.hashed_words(texts)
    items = [(i, "x", Counter(rng.sample(sorted(set(h.tolist())), 9))) for i in range(20)]
    df = Counter(w for _, _, c in items for w in c)
    index = de.Index(items, df, 20, 9.0, 32)
    whole = list(index.passages(h, row, 30))
    monkeypatch.setattr(de, "STEP", 3)
    assert list(index.passages(h, row, 30)) == whole and len(whole) > 20
    monkeypatch.setattr(de, "DENSE", 10)
    assert list(index.passages(h, row, 30)) == whole


def test_memory_of_one_long_text():
    text = pa.array([" ".join(f"w{i % 9999}" for i in range(400_000))])
    raw, h, row, _, _ = de.hashed_words(text)
    item = Counter(h[:40].tolist())
    index = de.Index([(1, "x", item)], dict.fromkeys(item, 1), 1, 40.0, 64)
    assert sum(1 for _ in index.passages(h, row, 1)) >= 40 and np.all(np.diff(row) == 0) and len(raw) > 2_000_000
