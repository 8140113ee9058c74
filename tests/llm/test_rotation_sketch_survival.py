"""Block rotation, SetSketch near-duplicates and survival words beside brute force, and on awkward rows."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockweave.llm import infill, setsketch, survival
from tests.llm.test_operators import LONG, SF, WORD, collected, docs_of, empty, five_words, odd, real, rows  # noqa: F401

# --- 11 fill in the middle -------------------------------------------------------------------------------------------

UNIT = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_move(doc_id, text, share=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= share:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_rotations_equal_cut_and_paste(spark, odd, real):
    rng = random.Random(3)
    bits = [" ", "\n", "\t ", "a", "Ünï", "𝒳𝒴", "<", "<P", "P>", "M>", "\x1c", "\x85"]
    made = [(i, "".join(rng.choices(bits, k=rng.randrange(0, 12))), "en", "a") for i in range(300)]
    made += [(900, "has <P> in it", "en", "a"), (901, "<S>", "en", "a"), (902, "end <M>", "en", "a")]
    for df in (odd, real, docs_of(spark, made)):
        out = infill.transform(df).withColumn("back", infill.restored()).collect()
        got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"].decode()) for r in out), key=repr)
        assert got == sorted(((i, *plain_move(i, t)) for i, t in collected(df)), key=repr)
        texts = sorted(((i, t or "") for i, t in collected(df)), key=repr)
        assert sorted(((r["doc_id"], r["back"].decode()) for r in out), key=repr) == texts
    assert infill.transform(empty(spark)).count() == 0


def test_shares_are_parameters(spark, odd):
    forms = lambda **k: {r["form"] for r in infill.transform(odd, **k).collect() if r["n"]}
    assert forms(share=0) == {"plain"} and "psm" not in forms(share=100, spm_share=100) and "spm" not in forms(share=100, spm_share=0)


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_rotating_twice_gives_the_buffer_again(monkeypatch, block):
    monkeypatch.setattr(infill, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(200):
        data = bytes(rng.randrange(256) for _ in range(rng.randrange(0, 60)))
        a, m, b = sorted(rng.randrange(len(data) + 1) for _ in range(3))
        buffer = bytearray(data)
        infill.rotate(buffer, a, m, b)
        assert bytes(buffer) == data[:a] + data[m:b] + data[a:m] + data[b:]
        infill.rotate(buffer, a, a + b - m, b)
        assert bytes(buffer) == data


# --- 12 SetSketch ----------------------------------------------------------------------------------------------------

def plain_components(docs, percent):
    """(doc_id, set size, component id) by comparing all pairs of sets."""
    sets = [five_words(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(docs)]


def planted(spark, seed=7):
    """Copies with a few words changed, chains of them, prefixes, groups around 0.85, and frequent phrases in texts of their own."""
    rng, given = random.Random(seed), []
    for k in range(14):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice((8, 40, 150, 700)))]
        given.append(words)
        for share in (0.003, 0.006, 0.01, 0.015, 0.02, 0.03):
            given.append([f"x{rng.randrange(9999)}" if rng.random() < share else w for w in (given[-1] if k % 3 else words)])
        given.append(words[:int(len(words) * 0.86) + 4])
    common = [f"common{i}" for i in range(40)]
    given += [common + [f"own{k}x{i}" for i in range(rng.choice((2, 6, 12)))] for k in range(30)]
    return docs_of(spark, [(100 + i, " ".join(w), "en", "a") for i, w in enumerate(given)])


@pytest.mark.parametrize("percent", [85, 80])
def test_every_similar_pair_is_linked(spark, odd, real, monkeypatch, percent):
    monkeypatch.setattr(setsketch, "CHUNK", 7)
    for df in (planted(spark), odd, real, empty(spark)):
        out = setsketch.near_duplicates(df, percent)
        assert rows(out.drop("root")) == sorted(plain_components(collected(df), percent), key=repr)


def test_pairs_just_below_the_similarity_are_decided_without_being_written(spark, monkeypatch):
    """150 texts with four words of one text changed: pairs are 0.76 alike, but for those that change the same places."""
    written, write = {}, setsketch.materialize

    def told(df, label="step"):
        out = write(df, label)
        written.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(setsketch, "materialize", told)
    monkeypatch.setattr(setsketch, "CHUNK", 40)
    rng = random.Random(11)
    base, texts = [f"w{i}" for i in range(300)], []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(300), 4) if i % 10 else (50, 120, 190, 260):
            words[at] = f"x{rng.randrange(10 ** 6)}"
        texts.append(" ".join(words))
    df = docs_of(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    want = sorted(plain_components(list(enumerate(texts)), 85), key=repr)
    assert rows(setsketch.near_duplicates(df).drop("root")) == want and 20 < sum(r[3] for r in want) < 150
    assert sum(written["pairs"]) < 600  # one for each text and turn; all pairs are 11,175


def test_ids_that_repeat_or_are_missing_do_not_join_components(spark):
    texts = [" ".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=60)) for k in range(4)]
    df = docs_of(spark, [(None, texts[0], "en", "a"), (None, texts[1], "en", "a"), (7, texts[2], "en", "a"), (7, texts[3], "en", "a"), (9, texts[3], "en", "a"), (5, " \n", "en", "a"), (6, None, "en", "a")])
    out = setsketch.near_duplicates(df).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in out), key=repr) == sorted(
        [(None, None, True), (None, None, True), (7, 7, True), (7, 7, True), (9, 7, False), (5, 5, True), (6, 6, True)], key=repr)
    assert len({r["root"] for r in out if r["n_shingles"]}) == 4


def test_sketches_merge_and_estimate():
    rng, s = np.random.default_rng(4), setsketch.Sketch(bands=256, rows=4)
    for j in (0.0, 0.3, 0.6, 0.85, 0.95):
        for ratio in (1.0, 0.97 if j > 0.9 else 0.9):
            n = 20_000
            both = int(j * (n + ratio * n) / (1 + j))
            pool = rng.integers(0, 2**63, 2 * n + 10, dtype=np.uint64)
            a, b = pool[:n], pool[n - both:n - both + int(ratio * n)]
            ra, rb, union = setsketch.registers([a, b, np.union1d(a, b)], s)
            assert setsketch.merge([ra.astype("<u2").tobytes(), rb.astype("<u2").tobytes()]) == union.astype("<u2").tobytes()
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            more, same = np.array([(ra > rb).sum()]), np.array([(ra == rb).sum()])
            found = setsketch.best_similarity(np.array([float(len(a))]), np.array([float(len(b))]), more, s.registers - more - same, same, s.base)
            assert abs(found[0] - true) < 0.06
            fits = setsketch.can_be(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]), 85, s.base)
            assert fits[0] == (true > 0.7)


def test_hashed_shingles_are_as_many_as_plain_ones(monkeypatch, spark, odd, real):
    texts = [t for df in (odd, real) for _, t in collected(df)] + ["a b c d ab ba", "x" * 5000 + " y z", "a b", "b a", "A  b", ""]
    for block in (1 << 20, 50):
        monkeypatch.setattr(setsketch, "BLOCK", block)
        sets = setsketch.shingle_sets([None if t is None else t.encode() for t in texts])
        assert [len(x) for x in sets] == [len(five_words(t)) for t in texts]
        every, plain = {}, {}
        for x, t in zip(sets, texts):
            plain.setdefault(frozenset(five_words(t)), set()).add(setsketch.set_key(x))
            every.setdefault(setsketch.set_key(x), set()).add(frozenset(five_words(t)))
        assert all(len(v) == 1 for v in (*every.values(), *plain.values()))
        assert len(set().union(*map(set, map(np.ndarray.tolist, sets)))) == len(set().union(*map(five_words, texts)))


def test_a_shingle_in_both_texts_has_one_register_value():
    x, y = setsketch.shingle_sets([b"a b c d e f g", b"A b  c d\te f g"])
    assert (setsketch.registers([x], setsketch.Sketch()) == setsketch.registers([y, np.zeros(0, np.uint64)], setsketch.Sketch())[:1]).all()


# --- 13 survival words -----------------------------------------------------------------------------------------------

def plain_failures(text):
    w = WORD.findall(text or "")
    return {f for f, bad in zip("ABCD", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in text or "") > 3 * len(text or ""),
                                         any(c in "#$%&*|" for c in text or ""))) if bad}


def plain_audit(docs, labels):
    good, toxic = ({d for d, *r in labels if d is not None and r[k] == 1} for k in (0, 1))
    out = []
    fails = []
    for d, text, part in docs:
        copy = d is not None and any((t or "") == (text or "") and o is not None and o < d for o, t, _ in docs)
        fails.append((d, part or "", plain_failures(text) | ({"E"} if copy else set())))
    for part in {p for _, p, _ in fails}:
        own, shapley, lines = [(d, f) for d, p, f in fails if p == part], dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = own
            for i, f in enumerate(order):
                gone = [d for d, x in left if f in x]
                left = [(d, x) for d, x in left if f not in x]
                shapley[f] += len(gone)
                failing = sum(f in x for _, x in own)
                lines.append((part, "".join(order), i + 1, len(left), len(gone), failing - len(gone), sum(x == {f} for _, x in own), sum(d in good for d in gone), sum(d in toxic for d in gone), f))
        out += [(*line[:-1], shapley[line[-1]]) for line in lines]
    return sorted(out, key=repr)


def test_audit_equals_every_order_applied(spark, odd, real):
    rng = random.Random(6)
    base = " ".join(f"word{i % 150}" for i in range(260))
    texts = [base, base.upper(), base + " 5%", "same " * 300, None, "", "short", base + "ÄÖ" * 40, "A" * 9 + " b" * 291]
    made = docs_of(spark, [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "en", "de"]), "a") for _ in range(120)])
    labels = spark.createDataFrame([(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(30), *range(10), None]], "doc_id bigint, quality int, toxic int")
    for df in (made, odd, real.select("*", F.lit(1).alias("part"), F.lit(2).alias("fails"))):
        said = [tuple(r) for r in labels.collect()]
        want = plain_audit([(r["doc_id"], r["text"], r["lang"]) for r in df.collect()], said)
        out = survival.audit(df, labels)
        assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        assert rows(out) == want
    assert survival.audit(empty(spark), labels).count() == 0
    assert rows(survival.audit(made, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost"))) == [(0, 0)]


def test_carry_save_counts_equal_plain_counts():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 3, 7, 64, 1001):
        words = rng.integers(0, 2**32, n, dtype=np.uint32)
        assert survival.positional_counts(words).tolist() == [int(((words >> np.uint32(p)) & 1).sum()) for p in range(32)]
    table = survival.survival_words(5)
    assert all((int(table[f]) >> s & 1) == (f & s == 0) for f in range(32) for s in range(32))


def test_long_texts_are_taken_whole(spark):
    df = docs_of(spark, [(1, LONG, "en", "a"), (2, LONG + " tail", "en", "a"), (3, LONG[: len(LONG) // 2], "en", "a")])
    assert rows(setsketch.near_duplicates(df).select("doc_id", "component_id")) == [(1, 1), (2, 1), (3, 1)]
    assert {r["form"]: r["n"] for r in infill.transform(df, share=100).collect()}
