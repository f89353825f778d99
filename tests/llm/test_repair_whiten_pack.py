"""Conversation repair, embedding whitening and vector packing against brute force, with odd inputs."""

import collections
import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from conftest import SF_SMALL
from feedrank.llm import conversation_repair as cr
from feedrank.llm import spaced_bpe, units, vector_packing, whitening, wordbpe

SHAPE = re.compile(r"(s?(ua)+)?")


# --- conversation repair -------------------------------------------------------------------------------------------

def _edits(rows, most_inserts=2):
    """Every edit sequence of ``rows [(role, text, fault)]`` with few inserts: (cost, audit, turns)."""
    options = []
    for role, text, fault in rows:
        late = 5 if fault == "truncated" else 0
        o = [(2, "D", None)]
        if fault in ("ok", "truncated"):
            o += [(late, "K", (role, text)), (1 + late, "R", ("user", text)), (1 + late, "R", ("assistant", text))]
        options.append(o)
    for chosen in itertools.product(*options):
        for k in range(most_inserts + 1):
            for at in itertools.combinations_with_replacement(range(len(rows) + 1), k):
                for roles in itertools.product(("user", "assistant"), repeat=k):
                    seq = []
                    for i in range(len(rows) + 1):
                        seq += [(5, "I", (r, "")) for a, r in zip(at, roles) if a == i]
                        if i < len(rows):
                            seq.append(chosen[i])
                    turns = [t for _, _, t in seq if t is not None]
                    if SHAPE.fullmatch("".join(r[:1] or " " for r, _ in turns)):
                        yield sum(c for c, _, _ in seq), "".join(e for _, e, _ in seq), turns


def _faults(rows):
    seen, out = set(), []
    for role, text in rows:
        tail = text.rstrip(cr.WHITE)
        if not tail:
            f = "blank"
        elif (role, text) in seen:
            f = "duplicate"
        else:
            f = "ok" if tail[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, f))
    return out


def _codes(rows):
    initial = {"s": cr.S, "u": cr.U, "a": cr.A}
    fault = {"ok": cr.OK, "truncated": cr.CUT, "blank": cr.BLANK, "duplicate": cr.TWICE}
    return "".join(cr.letter(initial.get(r[:1], cr.OTHER), fault[f]) for r, _, f in rows)


def test_lightest_derivation_equals_all_edit_sequences():
    r = random.Random(3)
    for _ in range(150):
        rows = [(r.choice(["user", "assistant", "system", "tool", "", " "]), r.choice(["a.", "b", "", "c!", "a.", " \t"]))
                for _ in range(r.randrange(0, 5))]
        facts = _faults(rows)
        cost, audit, turns = min(_edits(facts), key=lambda x: (x[0], x[1]))
        assert cr.lightest(_codes(facts)) == (cost, audit), facts
        got = list(cr._turns(audit, iter(rows)))
        assert [(role, text) for _, role, text in got] == turns


def test_blocks_change_nothing(monkeypatch):
    r = random.Random(5)
    codes = ["".join(chr(cr.FIRST + r.randrange(16)) for _ in range(n)) for n in (0, 1, 2, 7, 40, 333)]
    whole = [cr.lightest(c) for c in codes]
    for block in (1, 2, 5):
        monkeypatch.setattr(cr, "BLOCK", block)
        assert [cr.lightest(c) for c in codes] == whole


def _damaged(conversation):
    out = []
    for conv, turn, role, text in conversation:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()))


def _want(conversation):
    rows = _damaged(conversation)
    facts = _faults([x[1:] for x in rows])
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit = cr.lightest(_codes(facts))
    kept = [f"{role}:{text}" for _, role, text in cr._turns(audit, iter([x[1:] for x in rows]))]
    count = collections.Counter(f for _, _, f in facts)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"],
            illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def test_conversations_with_odd_rows(spark):
    r = random.Random(7)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, ""]), r.choice(["Hi there.", "so", "", None, "Why?\n", "x!"]))
            for c in [*range(60), None] for t in [*range(r.randrange(1, 9)), None] if r.random() < 0.9]
    rows += [(100, 5, "user", "again."), (100, 5, "user", "again."), (100, 5, "assistant", "tie."), (101, 3, "user", "w " * 200_000),
             (102, 9, None, None)]
    rows += [(103, t, r.choice(["user", "assistant"]), r.choice(["same.", "a.", f"t{t}."])) for t in range(700)]      # a hot conversation
    df = spark.createDataFrame([(*x, "clash", 1, "h") for x in rows], "conv_id long, turn long, role string, text string, c string, n int, `my col` string")
    got = {x[0]: tuple(x)[1:] for x in cr.repair_conversations(df).collect()}
    by = collections.defaultdict(list)
    for x in rows:
        by[x[0]].append(x)
    assert set(got) == set(by)
    for c in by:
        assert got[c] == _want(by[c]), c


def test_repaired_turns_and_empty_table(spark):
    rows = [("k", 0, "user", "Hello."), ("k", 1, "user", "And you?"), ("k", 2, "assistant", "Fine."), ("z", 0, "tool", "")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    plain = cr.undamaged(df)
    plans = cr.audits(plain)
    turns = {(x["conv"], x["position"]): (x["edit"], x["role"], x["text"]) for x in cr.repaired(plain, plans).collect()}
    assert turns == {("k", 0): ("K", "user", "And you?"), ("k", 1): ("K", "assistant", "Fine.")}
    assert cr.repair_conversations(df.limit(0)).count() == 0
    gone = cr.repair_conversations(df, damaged=False).filter("conv_id = 'z'").first()
    assert gone["audit"] == "D" and gone["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


# --- whitening -----------------------------------------------------------------------------------------------------

def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, k string, v string")


def _exact(rows):
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    cov = np.array([[float(sum((Fraction(r[i]) - Fraction(s[i], n)) * (Fraction(r[j]) - Fraction(s[j], n)) for r in x) / n)
                     for j in range(d)] for i in range(d)])
    return x, n, s, cov


def test_whitening_equals_brute_force(spark):
    r = np.random.default_rng(2)
    good = (r.normal(size=(90, 6)) @ r.normal(size=(6, 6)) * 30).tolist()
    good.append([1e9, -1e9, 1e8, 3.0, 2.0, -1e7])                                  # far outside the range of exact doubles
    odd = [None, [1.0, None, 2.0, 3.0, 4.0, 5.0], [float("nan")] + [0.0] * 5, [float("inf")] + [0.0] * 5, [], [1.0, 2.0], [1e300] * 6]
    rows = [(i, v, "k", "v") for i, v in enumerate(good)] + [(1_000 + i, v, "k", "v") for i, v in enumerate(odd)] + [(None, good[0], "k", "v"), (0, good[0], "k", "v")]
    used = good + [good[0], good[0]]
    x, n, s, cov = _exact(used)
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1], vector[:, ::-1]
    got = whitening.whiten(_vectors(spark, rows), most=4).collect()
    assert len(got) == 4 * len(used) and {g["n"] for g in got} == {n}
    by = collections.defaultdict(list)
    for g in got:
        by[g["vec_id"]].append(g)
    assert len(by[0]) == 8 and len(by[None]) == 4
    sign = {}
    for i in range(len(good)):
        assert {g["deviation"] for g in by[i]} == {d if (d := sum((n * a - b) ** 2 for a, b in zip(x[i], s))) < 1 << 63 else None}
        for g in by[i]:
            k = g["component"] - 1
            want = float((np.array([float(Fraction(a) - Fraction(b, n)) for a, b in zip(x[i], s)]) @ vector[:, k]) / np.sqrt(value[k]))
            if abs(want) > 1e-3:
                assert sign.setdefault(k, np.sign(want * g["whitened"])) == np.sign(want * g["whitened"])
            assert abs(abs(want) - abs(g["whitened"])) < 1e-6 * max(1, abs(want))
            assert abs(g["explained"] - value[k] / value.sum()) <= 1e-4 * value[k] / value.sum()
    z = np.array([[g["whitened"] for g in sorted(by[i], key=lambda g: g["component"])[:4]] for i in range(1, len(good))])
    assert z.shape[1] == 4 and got[0]["identity_error"] < 1e-4


def test_pair_squares_are_exact():
    r = np.random.default_rng(3)
    for top in (50, 10 ** 12, 2 ** 61):
        y = r.integers(-top, top, size=(40, 5))
        rows = [[int(v) for v in row] for row in y]
        want = [sum(a[i] ** 2 for a in rows) for i in range(5)] + [sum((a[i] + a[j]) ** 2 for a in rows) for i in range(5) for j in range(i + 1, 5)]
        assert whitening.pair_squares(y) == want
        table = whitening._limbs(5, whitening.pair_names(5), want)
        back = collections.Counter()
        for i, j, limb, v in zip(table["i"], table["j"], table["limb"], table["value"]):
            back[i, j] += v << (whitening.LIMB * limb)
        assert [back[n] for n in whitening.pair_names(5)] == want


def test_whitening_without_variance_and_rows(spark):
    same = whitening.whiten(_vectors(spark, [(1, [1.0, 2.0], "", ""), (2, [1.0, 2.0], "", "")])).collect()
    assert len(same) == 4 and all((g["whitened"], g["explained"], g["identity_error"], g["deviation"]) == (0, 0, 0, 0) for g in same)
    line = whitening.whiten(_vectors(spark, [(i, [float(i), 7.0], "", "") for i in range(10)])).collect()
    assert {(g["component"], g["explained"]) for g in line} == {(1, 1.0), (2, 0.0)} and line[0]["identity_error"] < 1e-9
    assert whitening.whiten(_vectors(spark, [])).count() == 0
    assert whitening.whiten(_vectors(spark, [(1, None, "", "")])).count() == 0


# --- vector packing ------------------------------------------------------------------------------------------------

def _library(path):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def test_spaced_encoder_equals_the_library():
    r = random.Random(1)
    parts = ["a", "é", "É", "中", "'s", "1", "22", ".", ",", "\n", " ", "  ", "\t", "!", "x.", "́", " ", "\x85", "\x1c", "\x0b",
             "İ", "Σ", "ς", "word", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "ﬁ", "ß", "I'll", "\U0001f642", "_", "**"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 25))) for _ in range(4000)] + ["", "   "]
    enc = spaced_bpe.SpacedEncoder(spaced_bpe.word_bpe_path())
    enc.table.most = 200                                  # units are forgotten on the way
    got = []
    for at in range(0, len(texts), 100):
        ids, size = enc.encode(pa.array(texts[at:at + 100]))
        got += [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]
    want = [e.ids for e in _library(spaced_bpe.word_bpe_path()).encode_batch(texts, add_special_tokens=False)]
    assert got == want


def test_forgotten_units_keep_their_ids():
    calls = []

    def code(new):
        calls.append(list(new))
        return [None if u == "odd" else [len(u)] * 2 for u in new]

    t = units.UnitTable(np.dtype("<u2"), code, most=5)
    for batch in (["a", "bb", "odd"], ["a", "odd", "ccc"], ["dddd", "eeeee", "a"], ["a", "odd", "ccc"]):
        n = t.numbers(batch)
        ids, stop = t.join(n)
        assert [ids[a:b].tolist() for a, b in zip(stop, stop[1:])] == [[] if u == "odd" else [len(u)] * 2 for u in batch]
        assert t.odd[n].tolist() == [u == "odd" for u in batch]
    assert calls[-1] == ["ccc"]                           # a and odd were met twice


def _one_by_one(lengths, caps, weights, score):
    """Plain best fit, a piece at a time: residuals of all sequences."""
    scale = np.array(weights) / np.array(caps, float) ** 2
    bins = []
    for length in sorted(lengths, reverse=True):
        need = np.array([length, 1, length * length])
        fits = [b for b in bins if (b >= need).all()]
        if not fits:
            bins.append(np.array(caps) - need)
        elif score == vector_packing.NORM:
            best = min(fits, key=lambda b: ((b - need).astype(float) ** 2 * scale).sum())
            best -= need
        else:
            best = max(fits, key=lambda b: (b * need * scale).sum())
            best -= need
    return bins


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_plan_equals_best_fit_piece_by_piece(score):
    r = random.Random(11)
    for docs, cost in ((None, None), (5, None), (None, 1600), (4, 1800)):
        lengths = [min(r.randrange(1, 40), r.randrange(1, 64)) for _ in range(400)]
        counts = collections.Counter(lengths)
        plan = vector_packing.best_fit(counts, 64, docs, cost, (1.0, 0.5, 0.25), score)
        caps = [64, docs or 64, cost or 4096]
        pieces = [(n, i) for n in counts for i in range(counts[n])]
        seq, off = plan.places(np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces]))
        by = collections.defaultdict(list)
        for (n, _), s, o in zip(pieces, seq.tolist(), off.tolist()):
            by[s].append((o, n))
        assert sorted(by) == list(range(plan.sequences))
        for held in by.values():
            held.sort()
            assert [o for o, _ in held] == np.concatenate([[0], np.cumsum([n for _, n in held])[:-1]]).tolist()
            assert sum(n for _, n in held) <= caps[0] and len(held) <= caps[1] and sum(n * n for _, n in held) <= caps[2]
        want = _one_by_one(lengths, caps, (1.0, 0.5, 0.25), score)
        if score == "norm":      # the same residuals; equal scores may break ties another way under the dot product
            assert sorted(tuple((np.array(caps) - [sum(n for _, n in h), len(h), sum(n * n for _, n in h)]).tolist()) for h in by.values()) == sorted(
                tuple(b.tolist()) for b in want)
        else:
            assert plan.sequences <= len(want) + 2
    with pytest.raises(ValueError):
        vector_packing.best_fit({65: 1}, 64)
    assert vector_packing.best_fit({}, 64).sequences == 0


def _check(got, texts, window, end_id, path):
    enc = _library(path)
    by, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for g in got:
        by[g["doc_id"]].append(g)
        seqs[g["sequence_id"]].append((g["offset"], g["length"]))
    assert set(by) == set(texts)
    for doc, text in texts.items():
        ids = enc.encode(text, add_special_tokens=False).ids + [end_id]
        at = 0
        for k, g in enumerate(sorted(by[doc], key=lambda g: g["piece"])):
            assert (g["piece"], g["start"]) == (k, at)
            part = ids[at:at + g["length"]]
            assert bytes(g["ids"]) == np.array(part, "<u4").tobytes()
            at += g["length"]
            assert g["length"] == window or at == len(ids)
        assert at == len(ids)
    for held in seqs.values():
        held.sort()
        at = 0
        for o, n in held:
            assert o == at
            at += n
        assert at <= window
    return len(seqs)


def test_vector_packing_of_documents(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(5)
    texts = {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}
    got = vector_packing.vector_pack(df, spaced_bpe.word_bpe_path()).collect()
    n = _check(got, texts, 2048, 0, spaced_bpe.word_bpe_path())
    total = sum(g["length"] for g in got)
    assert n <= -(-total // 2048) + 2
    few = vector_packing.vector_pack(df, spaced_bpe.word_bpe_path(), window=512, most_documents=3, most_attention=150_000 + 512 * 512,
                                     weights=(1.0, 1.0, 1.0)).collect()
    _check(few, texts, 512, 0, spaced_bpe.word_bpe_path())
    assert max(collections.Counter(g["sequence_id"] for g in few).values()) <= 3


def test_vector_packing_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "a " * 30_000), (5, "x <|endoftext|> y")]
    df = spark.createDataFrame([(*r, 1, "t", 0) for r in rows], "doc_id long, text string, task int, k string, place long")
    got = vector_packing.vector_pack(df, spaced_bpe.word_bpe_path()).collect()
    _check(got, {r[0]: r[1] or "" for r in rows}, 2048, 0, spaced_bpe.word_bpe_path())
    twice = spark.createDataFrame([(None, "one"), (None, "one"), (7, "two"), (7, "two")], "doc_id long, text string")
    again = vector_packing.vector_pack(twice, spaced_bpe.word_bpe_path()).collect()
    assert len(again) == 4 and len({(g["sequence_id"], g["offset"]) for g in again}) == 4
    assert vector_packing.vector_pack(twice.limit(0), spaced_bpe.word_bpe_path()).count() == 0


def test_byte_encoder_units_with_signs_and_line_feeds():
    r = random.Random(4)
    parts = ["word", "é", "**", "$$$", ".\n", "a.\nB", "\n\n", "\n", " ", " ", "'", "'s", "_", "9", "中"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 30))) for _ in range(3000)]
    enc = wordbpe.UnitEncoder(wordbpe.byte_bpe_path())
    got = [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)]
    assert got == [e.ids for e in _library(wordbpe.byte_bpe_path()).encode_batch(texts, add_special_tokens=False)]
