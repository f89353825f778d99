"""Operators of feedrank.llm against brute force, exact round trips and held-out accuracy, with odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib
from html import unescape

import numpy as np
import pytest

from conftest import SF_CHECK, SF_SMALL
from feedrank.llm import (html_text, jaccard_join, maxent_lm, merge_dropout, packing, paragraph_sketch, quality_model,
                          quality_rules, token_files, warc, wordbpe)
from feedrank.llm.common import shared_folder

DOC = "doc_id long, text string, lang string, source string, n_chars long, node long, k string, row string"


def _docs(spark, extra=()):
    """Nulls in every column, empty and long texts, ties, repeated rows, and clashing column names."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, "Alpha beta gamma.\nNext line, here", "en", "a", 3), (1, "Alpha beta gamma.\nNext line, here", "en", "a", 3),
            (2, None, None, None, None), (3, "", "en", None, 0), (4, "  \n \t", None, "b", 4), (5, long, "fr", "a", len(long)),
            (6, long + " tail", "fr", "a", 1), (None, "no key here at all, really", "en", "a", 1), (7, "one", "en", "a", 3),
            (8, "a  b   c   d▁e <|endoftext|> \U0001f642", "en", "a", 9), (-9, "x " * 300, "en", "a", 600), *extra]
    return spark.createDataFrame([(*r, 0, "k", "r") for r in rows], DOC)


def _empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def rows(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    return {r["doc_id"]: r["text"] or "" for r in d.select("doc_id", "text").collect()}


def _encode(texts):
    return [e.ids for e in wordbpe.encoder(wordbpe.byte_bpe_path()).tok.encode_batch(texts, add_special_tokens=False)]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_unit_encoder_equals_library():
    r = random.Random(1)
    parts = ["a", "é", "中", "'s", "1", "22", ".", ",", "\n", " ", "  ", "\t", " ", "!", "x.", "́", " ", "\x85"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 25))) for _ in range(3000)]
    got = wordbpe.encoder(wordbpe.byte_bpe_path()).encode(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == _encode(texts)


def test_unit_encoder_equals_a_fresh_library_on_added_tokens():
    from tokenizers import Tokenizer
    fresh = Tokenizer.from_file(wordbpe.byte_bpe_path())
    r = random.Random(6)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endoftext", "|>", "a", "é", " ", "  ", "\n", "word", "1", "."]
    texts = ["a <|endoftext|> b", "<|endoftext|>", *("".join(r.choice(parts) for _ in range(r.randrange(0, 12))) for _ in range(2000))]
    got = wordbpe.encoder(wordbpe.byte_bpe_path()).encode(texts)
    assert np.frombuffer(got[0], "<u2").tolist() == [64, 220, 50256, 275]
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [e.ids for e in fresh.encode_batch(texts, add_special_tokens=False)]


def test_elias_fano_select():
    r = np.random.default_rng(3)
    for n, top in ((1, 0), (1, 9), (5, 0), (1000, 50), (3000, 10**7)):
        v = np.sort(r.integers(0, top + 1, n))
        ef = token_files.EliasFano.build(v)
        for a, b in ((0, n), (n // 3, n // 2), (n - 1, n)):
            assert ef.select(a, b).tolist() == v[a:b].tolist()


@pytest.mark.parametrize("shard_bytes", [1 << 24, 40_000])
def test_token_files(spark, rows, shard_bytes):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = sorted(token_files.token_files(df, wordbpe.byte_bpe_path(), shard_bytes=shard_bytes).collect())
    start = 0
    keys = sorted(rows)
    for k, ids, r in zip(keys, _encode([rows[k] for k in keys]), got, strict=True):
        ids = ids + [0]
        assert tuple(r) == (k, start, len(ids), _crc(ids))
        start += len(ids)


def test_token_files_odd_rows(spark):
    got = token_files.token_files(_docs(spark), wordbpe.byte_bpe_path()).collect()
    assert len(got) == 11 and min(r["start"] for r in got if r["doc_id"] is None) == 0
    assert token_files.token_files(_empty(spark), wordbpe.byte_bpe_path()).count() == 0


def _check_packing(pieces, texts, window=2048):
    ids = {k: np.array(x + [1], "<u4") for k, x in zip(texts, _encode(list(texts.values())))}
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        assert p["doc_tokens"] == len(ids[p["doc_id"]])
        assert p["ids_crc32"] == _crc(ids[p["doc_id"]][p["start"]:p["start"] + p["length"]])
        by_doc[p["doc_id"]].append((p["start"], p["length"]))
        by_seq[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(by_doc) == set(ids)
    for part, total in [(sorted(v), len(ids[k])) for k, v in by_doc.items()] + [(sorted(v), None) for v in by_seq.values()]:
        at = 0
        for a, n in part:
            assert a == at and n > 0
            at += n
        assert at == total if total is not None else at <= window
    return sum(window - sum(n for _, n in v) for v in by_seq.values())


def test_packing_covers_every_id(spark, rows):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert _check_packing(packing.retrieval_pack(df, wordbpe.byte_bpe_path()).collect(), rows) < 2048
    small = packing.retrieval_pack(df, wordbpe.byte_bpe_path(), shard_bytes=100_000).collect()
    assert _check_packing(small, rows) < 2048 * 10


def test_packing_prefers_lexical_neighbours():
    # documents of two vocabularies alternate; a window should hold one vocabulary
    terms, docs = [], []
    for d in range(40):
        for w in range(30):
            terms.append((d % 2) * 1000 + (w * 7 + d) % 60)
            docs.append(d)
    index = packing.Bm25Index(np.array(terms, np.uint32), np.array(docs), 40)
    pieces = packing.pack_shard(np.full(40, 256), index, 1024)
    seqs = collections.defaultdict(set)
    for d, _, _, s, _ in pieces:
        seqs[s].add(d % 2)
    assert sum(len(v) == 1 for v in seqs.values()) >= len(seqs) - 1


def test_packing_odd_rows(spark):
    got = packing.retrieval_pack(_docs(spark).filter("doc_id is not null").dropDuplicates(["doc_id"]), wordbpe.byte_bpe_path())
    texts = {r["doc_id"]: r["text"] or "" for r in _docs(spark).filter("doc_id is not null").collect()}
    _check_packing(got.collect(), texts)
    assert packing.retrieval_pack(_docs(spark), wordbpe.byte_bpe_path()).filter("doc_id is null").count() == 1
    assert packing.retrieval_pack(_empty(spark), wordbpe.byte_bpe_path()).count() == 0


def test_quality_rules_measures():
    def brute(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        win = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        n = collections.Counter(win)
        hit = {j for i, x in enumerate(win) if n[x] > 1 for j in range(i, i + 5)}
        return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(hit))
    r = random.Random(2)
    for _ in range(400):
        t = "".join(r.choice(["a ", "b ", "é ", "a\n", "#", "a b a b a b ", "\x0b", " "]) for _ in range(r.randrange(60)))
        assert quality_rules.measure(t) == brute(t)


def test_quality_rules_odd_rows(spark):
    got = {(r["doc_id"], r["n_words"]): r for r in quality_rules.score_documents(_docs(spark)).collect()}
    assert got[(2, 0)]["base_failed"] and not got[(2, 0)]["kept"]
    assert quality_rules.score_documents(_docs(spark)).count() == 11
    assert quality_rules.score_documents(_empty(spark)).count() == 0
    assert quality_rules.keep_documents(_docs(spark)).columns == _docs(spark).columns


def test_quality_rules_adapt_and_keep_clean(spark):
    r = random.Random(4)
    w = [f"w{i}" for i in range(500)]
    clean = [(i, " ".join(r.choice(w) for _ in range(80)), "en", "a", 0) for i in range(300)]
    signs = [(1000 + i, " ".join(r.choice(w) + "***" for _ in range(80)), "en", "a", 0) for i in range(20)]
    own = [(2000 + i, " ".join(r.choice(w) + (" |" if j % 9 == 0 else "") for j in range(80)), "en", "tables", 0) for i in range(200)]
    df = spark.createDataFrame([(*x, 0, "", "") for x in clean + signs + own], DOC)
    kept = {x["doc_id"] for x in quality_rules.keep_documents(df).collect()}
    assert kept == set(range(300)) | set(range(2000, 2200))


def test_quality_classifier_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF_CHECK}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.score_documents(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) >= 0.95


def test_quality_classifier_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, None), (None, 1), (8, 0)], "doc_id long, quality int")
    got = quality_model.score_documents(_docs(spark), labels).collect()
    assert len(got) == 11 and all(0.0 <= r["score"] <= 1.0 for r in got)
    none = quality_model.score_documents(_docs(spark), labels.filter("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_model.score_documents(_empty(spark), labels).count() == 0


def _components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def _families(seed=5):
    r = random.Random(seed)
    w = [f"w{i}" for i in range(3000)]
    out = []
    for n in (12, 40, 150):
        base = [r.choice(w) for _ in range(n)]
        for _ in range(50):
            x = list(base)
            for _ in range(r.choice([0, 1, 1, 2, int(n * .03), int(n * .06)])):
                k = r.randrange(len(x))
                if r.random() < .6:
                    x[k] = r.choice(w)
                else:
                    x.insert(k, r.choice(w))
            out.append((len(out), " ".join(x)))
    return out + [(len(out) + i, " ".join(r.choice(w) for _ in range(r.randrange(6)))) for i in range(20)]


@pytest.mark.parametrize("size,percent,pivots", [(3, 90, 32), (5, 80, 2)])
def test_jaccard_join_equals_brute_force(spark, size, percent, pivots):
    rows = _families()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(df, size=size, percent=percent, pivots=pivots).collect()}
    assert got == _components(rows, size, percent)


@pytest.mark.parametrize("leaf,block", [(3, 512), (1000, 4)])
def test_jaccard_join_recursion_and_blocks_equal_brute_force(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = _families()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(df, size=5, percent=80, leaf=leaf).collect()}
    assert got == _components(rows, 5, 80)


def test_unlinked_near_copies_are_not_joined_pair_by_pair(spark, monkeypatch):
    # copies of one text, all alike and none linked: rows of pairs stay in proportion to the copies
    r = random.Random(3)
    base = [f"w{r.randrange(5000)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        x = list(base)
        for k in r.sample(range(300), 8):
            x[k] = f"n{i}x{k}"
        rows.append((i, " ".join(x)))
    made = []
    for name in ("_distances", "_linked"):
        def counted(pairs, *args, _old=getattr(jaccard_join, name)):
            made.append(pairs.count())
            return _old(pairs, *args)
        monkeypatch.setattr(jaccard_join, name, counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(df, size=3, percent=90).collect()}
    assert got == _components(rows, 3, 90)
    assert sum(made) <= 12 * len(rows)


def test_sets_of_the_join_are_written_in_buckets(spark, monkeypatch):
    # a join on the node moves the pairs, never the sets or the sketches
    seen = []
    for name in ("_distances", "_linked"):
        def kept(pairs, wide, *args, _old=getattr(jaccard_join, name)):
            seen.append(wide)
            return _old(pairs, wide, *args)
        monkeypatch.setattr(jaccard_join, name, kept)
    rows = _families()
    jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), size=5, percent=80).collect()
    assert len(seen) >= 3
    for wide in seen:
        joined = spark.range(9).withColumnRenamed("id", "node").hint("merge").join(wide, "node")
        assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("feedrank_")]


def test_documents_of_the_join_move_once_to_the_rows_that_are_kept(spark):
    rows = [(i, t) for i, t in _families()] + [(0, _families()[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = jaccard_join.keep_representatives(df)
    assert sorted(r[0] for r in kept.collect()) == sorted({c if n else i for i, (n, c) in _components(_families(), 5, 80).items()})
    grouped = [x for x in kept._jdf.queryExecution().optimizedPlan().toString().split("\n") if "min_by" in x]
    below = kept._jdf.queryExecution().optimizedPlan().toString().split(grouped[0])[1]
    assert grouped and "_rows" in below             # only rows equal in key and text are grouped


def test_signatures_that_agree_by_chance_link_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SIG_BYTES", 1)
    rows = _families()
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(
        spark.createDataFrame(rows, "doc_id long, text string"), size=5, percent=80).collect()}
    assert got == _components(rows, 5, 80)


def test_jaccard_join_of_rows_that_share_a_key(spark):
    # two texts under one key are two classes, each with near copies of its own
    a, b = ([f"{x}{k}" for k in range(60)] for x in "ab")
    near = lambda w, i: " ".join([*w[:-1], f"end{i}"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (1, " ".join(b)), (2, near(a, 2)), (3, near(b, 3)), (None, near(b, 4)), (5, near(["c"] * 60, 5))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_components(df, size=3, percent=90).collect()
    assert sorted((r[0] or 0, r[2]) for r in got) == [(0, 1), (1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (5, 5)]
    kept = jaccard_join.keep_representatives(df, size=3, percent=90)
    assert sorted(r["text"] for r in kept.collect()) == sorted([rows[0][1], rows[1][1], rows[6][1]])


def test_jaccard_join_odd_rows(spark):
    got = jaccard_join.jaccard_components(_docs(spark)).collect()
    assert len(got) == 11
    by = {r["doc_id"]: r for r in got}
    assert by[6]["component_id"] == 5 and by[2]["n_shingles"] == 0 and by[2]["component_id"] == 2
    kept = jaccard_join.keep_representatives(_docs(spark))
    assert kept.columns == _docs(spark).columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [-9, 1, 2, 3, 4, 5, 7, 8]
    assert kept.filter("doc_id is null").count() == 1
    assert jaccard_join.jaccard_components(_empty(spark)).count() == 0


def test_fingerprints_equal_exact_sets(spark, rows):
    got = {r["doc_id"]: r for r in paragraph_sketch.fingerprints(
        spark.read.parquet(f"{SF_SMALL}/documents.parquet"), shard_bytes=60_000).collect()}
    order = sorted(rows, reverse=True)

    def near(a, b):
        a, b = set(paragraph_sketch.keys(a).tolist()), set(paragraph_sketch.keys(b).tolist())
        return len(a & b) / len(a | b) if a | b else 1.0
    for k, n in zip(order, order[1:] + order[:1]):
        t, x = rows[k], rows[n]
        e = t[:len(t) - len(t) // 2] + x[:len(t) // 2]
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(near(t, e)) and r["near_next"] == pytest.approx(near(t, x))
    texts = collections.defaultdict(set)
    for k in order:
        texts[rows[k]].add(got[k]["fingerprint"])
    assert all(len(v) == 1 for v in texts.values())


def test_sketch_retries_until_it_peels():
    a = paragraph_sketch.keys("\n".join(f"line {i}" for i in range(900)))
    b = paragraph_sketch.keys("\n".join(f"line {i}" for i in range(300, 1500)))
    small = [paragraph_sketch.Sketch(x, paragraph_sketch.CELLS) for x in (a, b)]
    assert paragraph_sketch.difference(*small) is None
    assert paragraph_sketch.likeness(a, b, *small) == pytest.approx(600 / 1500)
    repeated = "\n".join(["a", "b", "c", "A", "B"] * 400)
    assert len(paragraph_sketch.keys(repeated)) == 2000


def test_fingerprints_odd_rows(spark):
    assert paragraph_sketch.fingerprints(_docs(spark)).count() == 11
    one = paragraph_sketch.fingerprints(spark.createDataFrame([(3, "a b c d")], "doc_id long, text string")).collect()
    assert [(r["near_next"], r["n_chars"]) for r in one] == [(1.0, 7)]
    assert paragraph_sketch.fingerprints(_empty(spark)).count() == 0


def test_merge_dropout_without_rate_equals_library(rows):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=merge_dropout.piece_path())
    enc = merge_dropout.DropoutEncoder(merge_dropout.piece_path(), 0, 0.0)
    texts = [*rows.values(), "", " ", "a  b\n c", "\n\nx", "é x", "ab" * 3000, "trail "]
    got = [np.frombuffer(x, "<u2").tolist() for x in enc.encode(texts, list(range(len(texts))))]
    assert got == sp.encode(texts)


def test_merge_dropout_is_lossless_varied_and_seeded(rows):
    texts = [*rows.values(), "", "▁", "a▁ ▁b", "\U0001f642 ퟿", "  \n\t "]
    enc = merge_dropout.DropoutEncoder(merge_dropout.piece_path(), 5, 0.1)
    a = enc.encode(texts, list(range(len(texts))))
    assert [enc.decode(x) for x in a] == texts
    again = merge_dropout.DropoutEncoder(merge_dropout.piece_path(), 5, 0.1).encode(texts, list(range(len(texts))))
    other = merge_dropout.DropoutEncoder(merge_dropout.piece_path(), 6, 0.1).encode(texts, list(range(len(texts))))
    assert a == again and a != other
    assert len({x for x in enc.encode(["international understanding " * 20] * 3, [1, 2, 3])}) == 3


def test_merge_dropout_batches_equal_the_heap_agenda(rows):
    enc = merge_dropout.DropoutEncoder(merge_dropout.piece_path(), 5, 0.2)
    units = sorted({u for t in list(rows.values())[:20] for u in enc.units(t)})[:1500]
    got = enc.encode_units(units, np.full(len(units), 3))
    for u, ids in zip(units, got):
        code = np.frombuffer(u.encode("utf-32-le", "surrogatepass"), np.uint32)
        salt = int(enc._salts(code, np.array([len(code)]), np.array([3]))[0])
        assert ids == enc._ids(u, enc._agenda(enc.of_char[code].tolist(), salt))


def test_merge_dropout_draws_each_occurrence_and_equals_its_agenda(rows):
    enc = merge_dropout.DropoutEncoder(merge_dropout.piece_path(), 5, 0.1)
    word = " internationalisation"
    got = {x for x in enc.encode([word] * 2000, list(range(2000)))}
    assert len(got) > 20 and {enc.decode(x) for x in got} == {word}
    texts = [*list(rows.values())[:10], "a" * 200 + " b"]
    keys = list(range(len(texts)))
    plain = enc.encode(texts, keys)
    enc._dropped = lambda unit, occurrence: np.arange(len(unit))     # every agenda is run
    assert enc.encode(texts, keys) == plain


def test_merge_dropout_odd_rows(spark):
    got = merge_dropout.roundtrip(_docs(spark), merge_dropout.piece_path()).collect()
    want = collections.Counter(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in _docs(spark).collect())
    assert collections.Counter(r["text_sha256"] for r in got) == want
    assert merge_dropout.roundtrip(_empty(spark), merge_dropout.piece_path()).count() == 0


def test_html_extraction_on_pages(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", html[r["page_id"]], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        want = "\n\n".join(x for x in blocks if x)
        assert (r["text"], r["n_chars"]) == (want, len(want))


def test_html_extraction_parts():
    p = "A sentence of the article with quite a few words in it, and &amp; some more. "
    page = f"""<html><body><header><p>{p}</p></header><nav><a href=x>{p}</a></nav><div class="cookie-notice">{p}</div>
    <div id="wrap"><div class="story"><p>{p}{p}</p><p>Two<br>lines {p}</p><form>{p}</form><ul><li><a href=a>link one</a><li><a href=b>two</a></ul>
    <script>if (a < b) document.write("<p>x</p>")</script><p>Last &lt;b&gt; 5 < 6</p></div>
    <div class="comments"><p>{p * 6}</p></div><aside>{p}</aside></div><footer>{p * 3}</footer></body></html>"""
    one = " ".join(unescape(p).split())
    assert html_text.main_text(page) == "\n\n".join([f"{one} {one}", f"Two lines {one}", "link one", "two", "Last <b> 5 < 6"])
    for odd in ("", "<", "<p", "<p>hi", "no markup", "<!-- x", "<script>x", "</p></div>", "<a href='x>y", "<p>a<p>b"):
        html_text.main_text(odd)
    assert html_text.main_text("<p>a<p>b") == "a\n\nb"
    assert html_text.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_html_extraction_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>t</p>", "x"), (1, "u", "", "x")],
                               "page_id long, url string, html string, text string")
    assert sorted((r["text"], r["n_chars"]) for r in html_text.extract(df).collect()) == [("", 0), ("", 0), ("t", 1)]
    assert html_text.extract(df.filter("false")).count() == 0


def test_loser_tree_merges_like_sorting():
    r = random.Random(1)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted((r.randrange(50), i) for _ in range(r.randrange(30))) for i in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs])) == sorted(x for y in runs for x in y)
    assert list(warc.LoserTree([])) == []


def _pages(spark):
    big = "<p>" + "x" * 200 + "é</p>"
    rows = [(5, "http://b.example/2", big), (3, "https://www.a.example:8080/1?q#f", big), (9, None, big), (4, "http://a.example/1", "tiny"),
            (6, "http://a.example/1", "tiny"), (7, "http://c.example/", None), (8, "u\r\nv", ""), (2, "http://a.example/1", "y" * 100),
            (1, "http://z.example/", "y" * 100)]
    return spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


def test_warc_round_trip(spark):
    folder = shared_folder(spark, "warc")
    index = warc.merge_index(warc.write_archives(_pages(spark), folder))
    got = warc.read_archives(index, folder).collect()
    pages = {r["page_id"]: (r["html"] or "").encode() for r in _pages(spark).collect()}
    first = {}
    for k in sorted(pages):
        if len(pages[k]) >= 100:
            first.setdefault(pages[k], k)
    for r in got:
        body = pages[r["page_id"]]
        rep = first.get(body, r["page_id"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if rep == r["page_id"] else ("revisit", rep))
    assert len(got) == 9
    order = [(r["url_key"], r["ts"], r["page_id"]) for r in sorted(got, key=lambda r: (r["part"], r["pos"]))]
    assert order == sorted(order)
    assert warc.archive(_pages(spark).filter("false")).count() == 0


def test_warc_repeated_ids_with_other_payloads(spark):
    a, b, c = ("<p>" + x * 200 + "</p>" for x in "abc")
    rows = [(1, a), (2, c), (5, a), (5, b), (5, c), (5, c), (6, b), (7, "tiny"), (7, a), (None, a)]
    got = warc.archive(spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").repartition(3)).collect()
    want = []
    for i, h in rows:
        first = min(k for k, x in rows if x == h and k is not None)
        again = len(h) >= 100 and i is not None and i != first
        want.append((i, hashlib.sha256(h.encode()).hexdigest(), "revisit" if again else "response", first if again else None))
    assert collections.Counter((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == collections.Counter(want)


def test_lm_scoring_equals_brute_force_base(spark, rows):
    got = {r["doc_id"]: r for r in maxent_lm.score_documents(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).collect()}
    tokens = {k: [*t.encode().lower().split(), b""] for k, t in rows.items()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in rows}
    c = collections.Counter(x for k, t in tokens.items() if not held[k] for x in t)
    n, v = sum(c.values()), len(c)
    for k, t in tokens.items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(t), sum(c[x] > 0 for x in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t))
    out = [k for k in rows if held[k]]
    assert sum(got[k]["score"] for k in out) > sum(got[k]["base_score"] for k in out)


def test_lm_probabilities_sum_to_one():
    r = np.random.default_rng(1)
    count = np.zeros(maxent_lm.CLASSES, np.int64)
    count[:-1] = r.integers(1, 50, maxent_lm.CLASSES - 1)
    m = maxent_lm.MaxEntModel(r.normal(size=(4096, maxent_lm.CLASSES)).astype(np.float32),
                              r.normal(size=maxent_lm.CLASSES).astype(np.float32), count, 10)
    p = m.class_probabilities(r.integers(0, 4096, (20, 4)))
    assert np.allclose(p.sum(axis=1), 1.0, atol=1e-5)


def test_lm_table_grows_and_counts_are_wide(spark):
    sizes = [maxent_lm.table_rows(n) for n in (0, 10 ** 7, 10 ** 8, 10 ** 10, 10 ** 13)]
    assert sizes == sorted(set(sizes)) and all(4 * math.sqrt(n) <= x for n, x in zip((0, 10 ** 7, 10 ** 8, 10 ** 10, 10 ** 13), sizes))
    # two parts of one word whose counts pass 32 bits together
    e = np.zeros(1, maxent_lm.ENTRY)
    e["h"], e["c"], e["g"] = 5, 4_000_000_000, 1
    words = spark.createDataFrame([("a", 0, e.tobytes()), ("b", 0, e.tobytes())], "pid string, bucket int, packed binary")
    got = {r["pid"]: r["packed"] for r in maxent_lm._sum_buckets(words, 1).collect()}
    assert np.frombuffer(got["a"], maxent_lm.BACK)["c"] == np.frombuffer(got["b"], maxent_lm.BACK)["c"] == 8_000_000_000


def test_lm_scoring_odd_rows(spark):
    got = maxent_lm.score_documents(_docs(spark)).collect()
    assert len(got) == 11 and all(math.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 4)} == {1}
    assert maxent_lm.score_documents(_empty(spark)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, docs, SF_SMALL)
        assert after.columns == docs.columns, name
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        left = {r["doc_id"] for r in after.collect()}
        assert left <= set(before)
        if name == "n-gram Jaccard join":
            comp = _components(list(before.items()), 5, 80)
            assert left == {i for i, (n, c) in comp.items() if n == 0 or c == i}
        docs = spark.createDataFrame(after.collect(), docs.schema)
    good = [k for k in before if quality.get(k) == 1]
    assert len(good) >= 0.9 * sum(v == 1 for k, v in quality.items())
    assert all(quality.get(k, 1) == 1 for k in left)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    _check_packing(corpus_pipeline.STAGES[3][1](spark, docs, SF_SMALL).collect(), texts)


def test_a_task_holds_few_signatures_and_buckets_are_small():
    # 16 bytes a signature, and about eight copies of them while they are packed or matched
    from feedrank.llm import jaccard_join as J
    assert 8 * 16 * J.FLUSH <= 32 << 20
    assert J.BUCKET_BYTES <= 8 << 20


def _unmixed(h):
    """The key whose hash is ``h``: both factors are odd and a shift by 33 undoes itself."""
    M = paragraph_sketch.M64
    for c in (paragraph_sketch._C2, paragraph_sketch._C1):
        h = (h ^ h >> 33) * pow(c, -1, M + 1) & M
    return h ^ h >> 33


def test_keys_that_share_every_cell_are_told_apart_by_another_try():
    h = 0x0123456789ABCDEF
    # equal in the 9 low bits of each row's 20 (every size that two keys were given), and equal in all 60
    for other in (h ^ 1 << 15, h ^ 1 << 62):
        x, y = (np.array([_unmixed(v)], np.uint64) for v in (h, other))
        assert paragraph_sketch._mix(int(x[0])) == h
        sx, sy = (paragraph_sketch.Sketch(k, paragraph_sketch.CELLS) for k in (x, y))
        assert paragraph_sketch.difference(sx, sy) is None
        assert paragraph_sketch.likeness(x, y, sx, sy) == 0.0


def test_rows_of_more_cells_than_20_bits_name_are_used(monkeypatch):
    monkeypatch.setattr(paragraph_sketch, "FINE", 16)
    x, y = (paragraph_sketch.keys("\n".join(f"line {i}" for i in r)) for r in (range(300), range(100, 400)))
    big = [paragraph_sketch.Sketch(k, 1_024, 3) for k in (x, y)]
    assert len(np.flatnonzero(big[0].count[:1_024])) > 200
    left, right = paragraph_sketch.difference(*big)
    assert sorted(left) == sorted(set(x.tolist()) - set(y.tolist())) and sorted(right) == sorted(set(y.tolist()) - set(x.tolist()))
