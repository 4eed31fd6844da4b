"""Each operator against a brute-force version, over odd rows and with small limits that exercise its splits."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lakejobs.llm import bpe, components, decontaminate, exact_dedup, jaccard, lexicon, license_scan, lmscore, quality, queries, secret_scan, suffix, textbytes, warc
from lakejobs.session import scratch_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(UPPER))


def rows_of(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# --- texts as bytes -------------------------------------------------------------------------------


def test_words_of_a_slice(odd_rows):
    import pyarrow as pa

    texts = [t for _, t in odd_rows]
    data, offsets = textbytes.text_bytes(pa.array(texts, pa.string()))
    w = textbytes.words(data, offsets)
    for i, text in enumerate(texts):
        assert w.text(w.first[i], w.first[i + 1]).split(" ") == (words_of(text) or [""])


def test_window_minima():
    values = np.random.default_rng(1).integers(0, 50, 97).astype(np.uint64)
    for width in (1, 2, 5, 96, 97, 98):
        expected = [values[i : i + width].min() for i in range(97 - width + 1)]
        assert textbytes.window_minima(values, width).tolist() == expected


# --- 1 WARC ---------------------------------------------------------------------------------------

PAGES = [(1, "http://a/x y", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b", None), (4, "http://b", ""), (None, "http://c", "<p>one</p>"),
         (5, "http://d\r\nX: 1", "ünï" * 5000), (5, "http://e", "ünï" * 5000), (6, "http://f", "\r\n\r\nWARC/1.1\r\n")]


@pytest.mark.parametrize("least", [0, 5])
def test_warc(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("_row", F.lit("clash"))
    folder = scratch_path(spark, "warc-test")
    index = warc.write_bundles(pages, folder, min_payload=least, frame_bytes=200, bundle_bytes=400)
    records = warc.read_bundles(spark, folder)
    got = [r.asDict() for r in warc.resolved(records).collect()]
    by_payload = defaultdict(list)
    for page, _, html in PAGES:
        by_payload[(html or "").encode()].append(page)
    expected = Counter()
    for payload, ids in by_payload.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        top = max((i for i in ids if i is not None), default=None)
        if len(payload) < least:
            expected.update((i, len(payload), digest, "response", None) for i in ids)
            continue
        rest = list(ids)
        rest.remove(top)
        expected[(top, len(payload), digest, "response", None)] += 1
        expected.update((i, len(payload), digest, "revisit", top) for i in rest)
    assert Counter((g["page_id"], g["payload_bytes"], g["payload_digest"], g["record_type"], g["refers_to"]) for g in got) == expected
    # Random access by index gives the same records as the scan; frames are independent and records start at their offsets.
    where = {(r.bundle, r.frame, r.offset): r.record_id for r in index.collect()}
    assert where == {(r.bundle, r.frame, r.offset): r.record_id for r in records.collect()}
    some = index.orderBy("record_id").limit(3).select("record_id")
    assert rows_of(warc.fetch_records(spark, folder, some), "record_id", "payload") == rows_of(records.join(some, "record_id"), "record_id", "payload")
    assert index.select("bundle").distinct().count() > 1


def test_warc_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    folder = scratch_path(spark, "warc-empty")
    warc.write_bundles(pages, folder)
    assert warc.resolved(warc.read_bundles(spark, folder)).count() == 0


# --- 2 BPE ----------------------------------------------------------------------------------------

TEXTS = ["Hello, world's it's we're I'LL you'd 'tis", "  two  spaces\n\nlines\t tabs   nbsp em　wide", "été größe ß ½ ² ª", "漢字かな交じり文 ①②③ ٣٤ Ω≈ç√ 😀👍🏽", "<|endoftext|>a<|endoftext|><|endoftext|> b<|endo",
         "", "a" * 3000, "ab" * 700 + "é" * 200, "\x00\x1c\x1d\x85\x0b\x0c mixed\r\n", "3.14159 1,000,000 x=1;y+=2 ((()))", " trailing   ", "ſ K İ ʼ 'ſ", "﻿bom ​zero", "é combining"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_bpe_is_the_librarys(spark, make_docs, odd_rows):
    rng = random.Random(3)
    alphabet = "abc ABC'é ß\n\t12½!?漢  😀՘"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(150)]
    rows = odd_rows + list(enumerate(texts, 1000))
    docs, path, lib = make_docs(rows).withColumn("ids", F.lit("clash")), queries.tokenizer_path(), library()
    block = bpe.corpus_lexicon(docs, path, words=100)
    assert 0 < lexicon.Lexicon(block).words <= 100
    for use in (None, block):
        decoded = bpe.decode(bpe.encode(docs, path, use), path)
        got = Counter((r.doc_id, r.text, bytes(r.ids), r.decoded) for r in decoded.collect())
        expected = Counter()
        for i, t in rows:
            ids = lib.encode(t or "", add_special_tokens=False).ids
            expected[(i, t, np.array(ids, "<u4").tobytes(), lib.decode(ids, skip_special_tokens=False))] += 1
        assert got == expected
        assert set(docs.columns) <= set(decoded.columns)


def test_decoding_goes_on_from_any_place_and_over_broken_bytes():
    import pyarrow as pa

    from lakejobs.llm import bpe

    tokens = [b"", b"ab", "\u00e9".encode(), b"\xe2\x82", b"\xac", b"c"]
    rows = [None, [], [1, 5], [2], [3, 4], [3, 5], [0], [4, 1], None, [5]]
    packed = pa.array([None if r is None else np.array(r, "<u4").tobytes() for r in rows], pa.binary())
    expected = [b"".join(tokens[i] for i in r or []).decode("utf-8", "replace") for r in rows]
    for a in range(len(rows) + 1):
        for b in range(a, len(rows) + 1):
            assert bpe._decoded(packed.slice(a, b - a), pa.array(tokens, pa.binary())).to_pylist() == expected[a:b]


def test_every_character_as_the_library():
    splitter, lib = bpe.Splitter(queries.tokenizer_path()), library().pre_tokenizer
    for c in [*range(0x2200), *range(0x3000, 0x3100), *range(0x10900, 0x10A00), 0x558, 0x3FC3B]:
        text = f"a{chr(c)}1 {chr(c)}{chr(c)}!"
        found = splitter.latin(text)
        found = [w.decode("latin-1") for w in found] if found is not None else splitter.other(text)
        assert found == [text[a:b] for _, (a, b) in lib.pre_tokenize_str(text)], hex(c)


def test_lexicon_is_minimal_and_exact():
    words = [b"tap", b"taps", b"top", b"tops", b"stop", b"stops", b"\xc3\xa9t\xc3\xa9", b"a"]
    block = lexicon.compile_lexicon({w: [i, i + 1][: 1 + i % 2] for i, w in enumerate(words)})
    table = lexicon.Lexicon.mapped(block)
    for i, w in enumerate(words):
        assert np.frombuffer(table.get(w), "<u4").tolist() == [i, i + 1][: 1 + i % 2]
    assert [table.get(w) for w in (b"", b"t", b"tapsy", b"b", b"sto")] == [None] * 5
    mixed = [b"", *words, b"t", b"tapsy", b"b", b"sto", *words[::-1]]
    assert table.get_all(mixed) == [table.get(w) for w in mixed]
    letters = sum(len(w) for w in words)
    assert table.states < letters  # shared suffixes
    assert lexicon.Lexicon(lexicon.compile_lexicon({})).get(b"a") is None


def test_memo_and_counter_bounds(spark, make_docs, odd_rows, monkeypatch):
    docs, path = make_docs(odd_rows), queries.tokenizer_path()
    counts = {r.word: r.n for r in bpe.word_counts(docs, path).collect()}
    assert counts[" the"] == sum((t or "").split(" ")[1:].count("the") for _, t in odd_rows if "same" not in (t or ""))
    encoder = bpe.Encoder(path, None)
    monkeypatch.setattr(bpe, "MEMO_WORDS", 5)
    lib = library()
    for _, t in odd_rows:
        assert encoder.encode(t or "") == np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
    assert len(encoder.latin) <= 5


def test_words_are_merged_side_by_side():
    rng, vocabulary = random.Random(5), bpe.Vocabulary(queries.tokenizer_path())
    words = [rng.randbytes(rng.randrange(1, 65)) for _ in range(400)] + [b"a" * n for n in range(1, 65)]
    words += ["".join(rng.choices(" etaoinshrdlu", k=rng.randrange(1, 30))).encode() for _ in range(3000)]
    assert vocabulary.merge_all(words) == [np.array(vocabulary.merge(w), "<u4").tobytes() for w in words]


def test_words_of_the_lexicon_are_looked_up_once(monkeypatch):
    path = queries.tokenizer_path()
    vocabulary = bpe.Vocabulary(path)
    encoder = bpe.Encoder(path, lexicon.compile_lexicon({w: vocabulary.merge(w) for w in (b"often", b" often")}))
    asked, get = Counter(), encoder.lexicon.get_all
    monkeypatch.setattr(encoder.lexicon, "get_all", lambda words: asked.update(words) or get(words))
    monkeypatch.setattr(bpe, "MEMO_WORDS", 20)
    for i in range(50):
        text = f"often often w{i}a x{i}b y{i}c " + "z" * 70
        assert encoder.encode(text) == np.array(library().encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert asked[b"often"] == asked[b" often"] == 1 and len(encoder.latin) <= 20


# --- 3 language model -----------------------------------------------------------------------------


def brute_scores(texts, corpus, order, alpha=lmscore.ALPHA):
    counts = Counter()
    for t in corpus:
        w = words_of(t)
        for n in range(1, order + 1):
            counts.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)
    out = []
    for t in texts:
        w, score = words_of(t), 0.0
        for i in range(len(w)):
            n, lost = min(i + 1, order), 0.0
            while n > 1 and not counts[tuple(w[i - n + 1 : i + 1])]:
                n, lost = n - 1, lost + math.log(alpha)
            gram = tuple(w[i - n + 1 : i + 1])
            score += lost + math.log(max(counts[gram], 1)) - math.log(counts[gram[:-1]] if n > 1 else total)
        out.append((len(w), score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, make_docs, odd_rows, order, monkeypatch):
    monkeypatch.setattr(lmscore, "HOT_WORDS", 20)
    monkeypatch.setattr(lmscore, "BUCKET_GRAMS", 4000)
    docs, texts = make_docs(odd_rows), [t for _, t in odd_rows]
    by_row = lambda df: sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.micros / 1e6) for r in df.collect())

    def same(got, expected):
        for (i, n, s), (j, m, e) in zip(got, sorted(expected), strict=True):
            assert (i, n) == (j, m) and s == pytest.approx(e, abs=1e-5 + 2e-6 * n)

    ids = [i if i is not None else -1 for i, _ in odd_rows]
    own = brute_scores(texts, texts, order)
    expected = [(i, n, s) for i, (n, s) in zip(ids, own, strict=True)]
    same(by_row(lmscore.score_corpus(docs, order)), expected)
    same(by_row(lmscore.score_documents(docs, lmscore.ngram_counts(docs, order), order)), expected)
    other = make_docs(odd_rows[:6])
    expected = [(i, n, s) for i, (n, s) in zip(ids, brute_scores(texts, texts[:6], order), strict=True)]
    same(by_row(lmscore.score_documents(docs, lmscore.ngram_counts(other, order), order)), expected)


def test_scores_of_frequent_grams(spark, make_docs, monkeypatch):
    monkeypatch.setattr(lmscore, "HOT_WORDS", 0)
    texts = [f"the common line w{i} w{i % 7}" for i in range(200)]
    got = {r.doc_id: r.micros / 1e6 for r in lmscore.score_corpus(make_docs(list(enumerate(texts)))).collect()}
    for i, (_, s) in enumerate(brute_scores(texts, texts, 2)):
        assert got[i] == pytest.approx(s, abs=1e-4)
    assert lmscore.score_corpus(make_docs([])).count() == 0


def brute_held_out(texts, order):
    """Each text by the counts of the others."""
    return [brute_scores([t], texts[:i] + texts[i + 1 :], order)[0] for i, t in enumerate(texts)]


@pytest.mark.parametrize(("order", "hot"), [(1, 20), (3, 0), (3, 20), (4, 60_000)])
def test_scores_by_other_documents(make_docs, odd_rows, order, hot, monkeypatch):
    monkeypatch.setattr(lmscore, "HOT_WORDS", hot)
    rows = odd_rows + [(900, "qzx jvk wpf bhg")]
    expected = sorted((i if i is not None else -1, n, s) for (i, _), (n, s) in zip(rows, brute_held_out([t for _, t in rows], order), strict=True))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.micros / 1e6) for r in lmscore.score_held_out(make_docs(rows), order).collect())
    for (i, n, s), (j, m, e) in zip(got, expected, strict=True):
        assert (i, n) == (j, m) and s == pytest.approx(e, abs=1e-5 + 2e-6 * n)
    assert lmscore.score_held_out(make_docs([])).count() == 0


@pytest.mark.parametrize(("pack", "after"), [(3000, 1 << 30), (3000, 20_000), (8 << 20, 20_000)])
def test_scores_by_other_documents_in_packs(spark, make_docs, odd_rows, pack, after, monkeypatch):
    """Small packs and hash ranges; files that the second scan splits otherwise than the first cut packs apart."""
    monkeypatch.setattr(lmscore, "HELD_PACK_BYTES", pack)
    monkeypatch.setattr(lmscore, "BUCKET_GRAMS", 4000)
    folder = scratch_path(spark, "lm-packs").removeprefix("file:")
    Path(folder).mkdir(parents=True)
    pq.write_table(make_docs(odd_rows).toArrow(), f"{folder}/documents.parquet", row_group_size=4)
    before, beside = spark.conf.get("spark.sql.files.maxPartitionBytes"), lmscore.beside_scan

    def then_split(*args):
        cut.append(spark.read.parquet(f"{folder}/documents.parquet").rdd.getNumPartitions())
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(after))
        cut.append(spark.read.parquet(f"{folder}/documents.parquet").rdd.getNumPartitions())
        return beside(*args)

    cut: list[int] = []
    monkeypatch.setattr(lmscore, "beside_scan", then_split)
    try:
        got = lmscore.score_held_out(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (cut[0] != cut[1]) == (after < 1 << 30)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.micros / 1e6) for r in got)
    expected = sorted((i if i is not None else -1, n, s) for (i, _), (n, s) in zip(odd_rows, brute_held_out([t for _, t in odd_rows], 3), strict=True))
    for (i, n, s), (j, m, e) in zip(got, expected, strict=True):
        assert (i, n) == (j, m) and s == pytest.approx(e, abs=1e-5 + 2e-6 * n)


def test_packed_ngrams_take_less_than_seven_bytes():
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(400)]
    batch = pa.RecordBatch.from_pydict({"_row": list(range(400)), "_text": texts})
    rows = [r for b in lmscore._held_packs(3, 6)(iter([batch])) for r in b.to_pylist()]
    distinct = len({(size, *w[i : i + size]) for w in (t.split(" ") for t in texts) for size in (1, 2, 3) for i in range(len(w) - size + 1)})
    assert sum(r["count"] or 0 for r in rows) == distinct
    assert sum(len(r["block"] or b"") for r in rows) < 7 * distinct


def test_registered_scores_rank_junk_last(spark, make_docs):
    texts = [f"the common line of words number {i % 3}" for i in range(30)] + ["qzx jvk wpf bhg tty mmn"]
    folder = scratch_path(spark, "lm")
    make_docs(list(enumerate(texts))).write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r.mean_log_score for r in queries.op3_lm_score(spark, folder.removeprefix("file:")).collect()}
    assert len(got) == 31 and min(got, key=got.get) == 30


# --- 4 decontamination ----------------------------------------------------------------------------


def brute_contamination(docs, items, window=10):
    out = []
    for i, text in docs:
        w, hit, found = words_of(text), set(), set()
        for item, item_text in items:
            v = words_of(item_text)
            n = min(window, len(v))
            if not n:
                continue
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    found.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


@pytest.mark.parametrize("filtered", [True, False])
def test_contamination(spark, make_docs, odd_rows, filtered, monkeypatch):
    if not filtered:
        monkeypatch.setattr(decontaminate, "FILTER_FROM_ROWS", -1)
    texts = dict(odd_rows)
    w = texts[11].split(" ")
    items = [(1, " ".join(w[50:75])), (2, " ".join(w[50:75]).upper()), (3, " ".join(w[100:110])), (4, " ".join(w[200:209])), (5, "x"), (6, None), (7, ""),
             (None, "one, two - THREE"), (8, "same " * 12), (8, " ".join(w[300:304])), (9, texts[15]), (10, "nowhere to be found in any of these texts at all really")]
    rng = random.Random(5)
    for n in range(40):
        at = rng.randrange(len(w) - 30)
        items.append((100 + n, " ".join(["odd"] * rng.randrange(3) + w[at : at + rng.randrange(1, 30)] + ["end"] * rng.randrange(3))))
    docs, bench = make_docs(odd_rows), spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.contamination(docs, bench).withColumn("n", decontaminate.hit_words(F.col("spans")))
    got = Counter((r.doc_id, r.n_words, r.n, tuple(r.item_ids)) for r in found.collect())
    assert got == brute_contamination(odd_rows, items)
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns
    expected = Counter({k[0]: n for k, n in got.items() if not k[2]})
    dropped = Counter(k[0] for k in got.elements() if not k[2])
    assert Counter(r.doc_id for r in clean.collect()) == dropped and expected
    assert decontaminate.contamination(docs, bench.limit(0)).where(F.size("spans") > 0).count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


# --- 5 Jaccard join -------------------------------------------------------------------------------


def shingles(text, k=5):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def brute_groups(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    first = {}
    for i, (doc, _) in enumerate(rows):
        r = root(i)
        first[r] = min(first.get(r, (True, 0)), (doc is None, doc if doc is not None else 0))
    return Counter((doc, None if first[root(i)][0] else first[root(i)][1], links[i]) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("block", [256, 3])
def test_similar_groups(spark, make_docs, odd_rows, block):
    rng = random.Random(11)
    base = [f"v{rng.randrange(500)}" for _ in range(200)]
    rows = list(odd_rows)
    for n in range(25):  # one large group of near copies, with chains
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(200)] = f"z{n}"
        rows.append((500 + n, " ".join(copy)))
    docs = make_docs(rows)
    got = jaccard.similar_groups(docs, block=block, recall=0.999999)
    assert rows_of(got, "doc_id", "class_id", "n_links") == brute_groups(rows)
    if block == 256:
        left = jaccard.drop_similar(docs)
        assert left.columns == docs.columns
        assert left.count() == got.where("_row = keep_row").count() == got.select("keep_row").distinct().count()
        assert jaccard.similar_groups(docs.limit(0)).count() == 0


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = jaccard.bands_for(threshold, 0.99)
        assert 1 - (1 - threshold**rows) ** bands >= 0.99 - 1e-9 and bands * rows <= 128


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


# --- 6 exact dedup --------------------------------------------------------------------------------


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        rest = list(ids)
        rest.remove(keep)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out[(keep, keep, len(ids), True, sha)] += 1
        out.update((i, keep, len(ids), False, sha) for i in rest)
    return out


def test_exact_groups(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    assert rows_of(exact_dedup.exact_groups(docs), "doc_id", "keep_id", "group_size", "kept", "digest") == brute_exact(odd_rows)
    path = scratch_path(spark, "docs")
    docs.repartition(4).write.parquet(path)
    stored = spark.read.parquet(path)
    assert rows_of(exact_dedup.exact_groups(stored), "doc_id", "keep_id", "group_size", "kept", "digest") == brute_exact(odd_rows)
    left = exact_dedup.drop_copies(stored)
    assert left.columns == docs.columns and left.count() == sum(n for k, n in brute_exact(odd_rows).items() if k[3])
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_equal_digests_are_not_believed(spark, make_docs, odd_rows):
    weak = lambda text: F.lpad(F.pmod(F.octet_length(text), F.lit(2)).cast("string"), 4, "0")
    got = exact_dedup.exact_groups(make_docs(odd_rows), digest=weak)
    expected = Counter(k[:4] for k in brute_exact(odd_rows).elements())
    assert rows_of(got, "doc_id", "keep_id", "group_size", "kept") == expected


def test_state_goes_on_over_batches(spark, make_docs):
    table, checkpoint = scratch_path(spark, "arriving"), scratch_path(spark, "state")
    with exact_dedup.on_disk_state(spark):
        for rows in ([(5, "a"), (6, "b")], [(3, "a"), (9, "a")]):
            exact_dedup.arrivals(make_docs(rows)).write.mode("append").parquet(table)
            schema = spark.read.parquet(table).schema
            exact_dedup.start_dedup(spark.readStream.schema(schema).parquet(table), checkpoint).awaitTermination()
        got = {r["first"]["id"]: r.group_size for r in exact_dedup.read_state(spark, checkpoint).collect()}
    assert got == {3: 3, 6: 1}


# --- 7 suffix arrays ------------------------------------------------------------------------------


def brute_repeats(rows, length, keep_first=False):
    seen = defaultdict(list)
    texts = [(t or "").encode() for _, t in rows]
    for r, text in enumerate(texts):
        for p in range(len(text) - length + 1):
            seen[text[p : p + length]].append((r, p))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for r, p in places[1 if keep_first else 0 :]:
                gone[r][p : p + length] = True
    out = []
    for (i, _), text, g in zip(rows, texts, gone, strict=True):
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], g.astype(int)])) == 1))
        out.append((i, len(text), int(g.sum()), runs, bytes(b for b, x in zip(text, g, strict=True) if not x)))
    return Counter(out)


def repeats(docs, **options):
    out = suffix.without_repeats(docs, **options)
    return Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in out.collect())


@pytest.mark.parametrize(("length", "block", "chunk", "levels"), [(400, 2000, 8 << 20, 1), (100, 2, 8 << 20, 1), (100, 2, 8 << 20, 0), (100, 2000, 700, 1)])
def test_repeats(make_docs, odd_rows, length, block, chunk, levels, monkeypatch):
    monkeypatch.setattr(suffix, "LEVELS", levels)
    monkeypatch.setattr(suffix, "BLOCK_SEGMENTS", block)
    monkeypatch.setattr(suffix, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix, "SORT_BYTES", 2_000)
    docs = make_docs(odd_rows)
    assert repeats(docs, length=length) == brute_repeats(odd_rows, length)


@pytest.mark.parametrize("block", [2000, 2])
def test_first_copies_stay(spark, odd_rows, block, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK_SEGMENTS", block)
    docs = spark.createDataFrame(odd_rows, "doc_id bigint, text string").coalesce(1)
    order = [(r.doc_id, r.text) for r in docs.collect()]
    assert repeats(docs, length=100, keep_first=True) == brute_repeats(order, 100, keep_first=True)
    assert suffix.without_repeats(docs.limit(0)).count() == 0


def test_longest_previous():
    rng = np.random.default_rng(4)
    data = np.concatenate([rng.integers(0, 2, 300), rng.integers(0, 3, 200)]).astype(np.uint8)
    data = np.concatenate([data, data[40:260], data[::-1]])
    text, length = data.tobytes(), 8
    starts = np.arange(len(data) - length + 1)
    room = len(data) - starts
    lpf, source = suffix.longest_previous(data, starts, room, length)
    for i in starts.tolist():
        best = 0
        for j in range(i):
            n = 0
            while i + n < len(text) and text[i + n] == text[j + n]:
                n += 1
            best = max(best, n)
        if best < length:
            assert lpf[i] == 0
        else:  # found in steps of eight, up to twice the depth of the order
            assert min(best, 8) <= lpf[i] <= best
            assert text[i : i + lpf[i]] == text[source[i] : source[i] + lpf[i]] and source[i] < i


# --- 8 quality ------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0)
    judged = quality.judged(docs, seen).join(labels.join(seen, "doc_id", "left_anti"), "doc_id").collect()
    assert len(judged) > 80
    good = [(r.quality == 1) == (r._p_good >= 0.5) for r in judged]
    clean = [r._accepted for r in judged if r.quality == 1 and r.toxic == 0]
    assert sum(good) / len(good) > 0.97 and sum(clean) / len(clean) > 0.97


def test_toxic_documents_go_whatever_their_site(make_docs, monkeypatch):
    logit = lambda p: math.log(p / (1 - p))
    evidence = {"good": (0.99, 0.01), "toxic": (0.99, 0.70), "bad": (0.01, 0.01), "fair": (0.70, 0.30)}

    def given(docs, model, text_col):
        column = lambda k: F.coalesce(*[F.when(F.col(text_col) == t, F.lit(logit(p[k]))) for t, p in evidence.items()])
        return docs.withColumns({"_good": column(0), "_toxic": column(1)})

    monkeypatch.setattr(quality, "fit", lambda *_: object())
    monkeypatch.setattr(quality, "with_evidence", given)
    rows = [(3 * i, "good") for i in range(60)] + [(3 * i + 1, "bad") for i in range(60)] + [(900, "toxic"), (902, "fair")]
    judged = {r.doc_id: r for r in quality.judged(make_docs(rows), None).collect()}
    assert judged[0]._accepted and not judged[1]._accepted
    assert judged[900]._posterior > 0.5 and not judged[900]._accepted  # in a good section
    assert judged[902]._accepted


def test_quality_shrinks_sparse_sites(spark):
    scored = spark.createDataFrame(
        [("big", "", 0.9)] * 300 + [("bad", "", 0.1)] * 300 + [("mid", "", 0.5 + 0.3 * (-1) ** i) for i in range(300)] + [("new", "", 0.1)],
        "host string, section string, p double",
    )
    sites, overall = quality.site_posteriors(scored)
    site = {r.host: r.site for r in sites.collect()}
    assert abs(site["big"] - 0.9) < 0.02 and abs(site["bad"] - 0.1) < 0.02
    assert site["bad"] < site["new"] < overall + 0.01


def test_posterior_of_a_document_by_the_others_of_its_site(make_docs, monkeypatch):
    """A second computation of the posterior: no document's own evidence is in its site term."""
    rng = random.Random(6)
    rows = [(i, f"t{rng.randrange(9)}") for i in range(90)] + [(300, "t1"), (None, "t2")]
    evidence = {f"t{k}": -3 + 0.7 * k for k in range(9)}

    def given(docs, model, text_col):
        column = F.coalesce(*[F.when(F.col(text_col) == t, F.lit(x)) for t, x in evidence.items()])
        return docs.withColumns({"_good": column, "_toxic": F.lit(-9.0)})

    monkeypatch.setattr(quality, "fit", lambda *_: object())
    monkeypatch.setattr(quality, "with_evidence", given)
    docs = make_docs(rows).withColumn("source", F.when(F.col("doc_id") == 300, "lone.org/x").otherwise(F.concat(F.col("source"), F.lit("/p"), F.coalesce(F.col("doc_id"), F.lit(0)) % 4)))
    sides = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    p_of = lambda t: 1 / (1 + math.exp(-evidence[t]))
    part = docs.select(quality.host_of(F.col("source")).alias("host"), quality.section_of(F.col("source"), F.col("lang")).alias("section"), F.coalesce(*[F.when(F.col("text") == t, F.lit(p_of(t))) for t in evidence]).alias("p"))
    sites, overall = quality.site_posteriors(part)
    k = sites.first()
    assert abs(overall - sum(p_of(t) for _, t, _ in sides) / len(sides)) < 1e-12
    expected = {}
    for i, t, source in sides:
        host, section = source.split("/")
        others = [(s, p_of(x)) for j, x, s in sides if (j, x, s) != (i, t, source)]
        at_host, here = [p for s, p in others if s.split("/")[0] == host], [p for s, p in others if s == source]
        host_share = (sum(at_host) + k.k_host * overall) / (len(at_host) + k.k_host)
        share = (sum(here) + k.k_section * host_share) / (len(here) + k.k_section)
        odds = lambda x: math.log(x / (1 - x))
        shift = min(max(odds(share) - odds(overall), -quality.SITE_LIMIT), quality.SITE_LIMIT)
        expected[i] = (share, 1 / (1 + math.exp(-(evidence[t] + shift))))
    got = {r.doc_id: (r._site, r._posterior) for r in quality.judged(docs, None).collect()}
    assert set(got) == set(expected)
    for i, (share, posterior) in expected.items():
        assert abs(got[i][0] - share) < 1e-9 and abs(got[i][1] - posterior) < 1e-9
    assert abs(got[300][0] - overall) < 1e-9  # nothing but the prior speaks for a document that is alone


def test_quality_of_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows).withColumn("_accepted", F.lit("clash")).withColumn("source", F.when(F.col("doc_id") > 3, F.col("source")))
    labels = spark.createDataFrame([(i, int(i % 2), None) for i in range(100, 130)] + [(None, 1, 0), (1, None, 1)], "doc_id bigint, quality int, toxic int")
    assert quality.judged(docs, labels).count() == len(odd_rows)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(odd_rows)
    assert quality.keep_good(docs, labels.where("quality = 1")).count() == len(odd_rows)
    assert quality.keep_good(docs.limit(0), labels).count() == 0
    hosts = spark.createDataFrame([("https://A.org/docs/x?y",), ("a.org",), (None,), ("src3",)], "s string")
    assert [tuple(r) for r in hosts.select(quality.host_of(F.col("s")), quality.section_of(F.col("s"))).collect()] == [("a.org", "docs"), ("a.org", ""), ("", ""), ("src3", "")]


# --- 9 licences -----------------------------------------------------------------------------------

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def test_licences(make_docs, odd_rows):
    texts = ["This is under the GNU General Public License, v3", "MIT License MIT license, mit-license", "Apache\nLicense and CC BY and cc-by 4.0 by cc", "gnu general public", "license mit license",
             "Permission is hereby granted, free of charge, to any person", "permission is hereby granted free of any charge", "GNU Lesser General Public License", "Licensed under the Apache License, Version 2.0.", "mıt license", "CC by", "by cc"]
    rows = odd_rows + list(enumerate(texts, 2000))
    expected = Counter()
    for i, t in rows:
        w = words_of(t)
        places = sorted((k, label) for p, label in PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        labels = ",".join(sorted({label for _, label in places}))
        expected[(i, len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, labels)] += 1
    got = license_scan.license_report(make_docs(rows))
    assert rows_of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == expected
    by_id = {r.doc_id: r for r in got.where("doc_id >= 2000").collect()}
    assert by_id[2005].labels == "mit" and by_id[2005].base_labels == "" and by_id[2006].labels == "" and by_id[2007].labels == "lgpl"
    assert by_id[2008].labels == "apache" and all(0 <= r.score <= 1 and (r.n_base == 0 or r.score == 1) for r in by_id.values())
    assert license_scan.license_report(make_docs([])).count() == 0


def brute_licences(rows, templates=license_scan.TEMPLATES):
    """(doc, labels, score) by looking at every place of every template."""
    docs = [(i, words_of(t)) for i, t in rows]
    holding = Counter(w for _, words in docs for w in set(words))
    idf = lambda w: math.log((1 + len(docs)) / (1 + holding[w])) + license_scan.LEAST_WEIGHT
    out = Counter()
    for i, w in docs:
        labels, best = set(), 0.0
        for t in templates:
            words, key = t.text.split(), t.key.split()
            first = next(k for k in range(len(words)) if words[k : k + len(key)] == key)
            rare = sorted(range(first, first + len(key)), key=lambda k: (-idf(words[k]), k))[: license_scan.RARE_WORDS]
            for start in range(-len(words), len(w)):
                at = lambda k: w[start + k] if 0 <= start + k < len(w) else None  # noqa: B023, E731
                if any(at(k) != words[k] for k in [*rare, *range(first, first + len(key))]):
                    continue
                score = min(1.0, sum(idf(x) for k, x in enumerate(words) if at(k) == x) / sum(map(idf, words)))
                if t.base or score >= license_scan.LEAST_SCORE:
                    labels.add(t.label)
                    best = max(best, score)
        out[(i, ",".join(sorted(labels)), round(best, 9))] += 1
    return out


def test_licence_labels_and_scores(make_docs, odd_rows):
    rng = random.Random(12)
    paragraphs = [t.text for t in license_scan.PARAGRAPHS]
    rows = list(odd_rows)
    for n, text in enumerate(paragraphs):
        w = text.split()
        changed = [x if rng.random() > 0.15 else "other" for x in w]
        rows += [(5000 + 10 * n, "x " * rng.randrange(9) + text + " and more"), (5001 + 10 * n, " ".join(changed)), (5002 + 10 * n, " ".join(w[: len(w) // 3])), (5003 + 10 * n, " ".join(w[len(w) // 2 :]))]
        rows += [(5004 + 10 * n, " ".join(rng.sample(w, len(w))) + " mit license")]
    rows += [(6000, " ".join(paragraphs)), (6001, "the license the license apache license the")]
    got = Counter((r.doc_id, r.labels, round(r.score, 9)) for r in license_scan.license_report(make_docs(rows)).collect())
    assert got == brute_licences(rows)
    assert {x for i, labels, _ in got if i is not None and 5000 <= i < 6000 and i % 10 == 0 for x in labels.split(",")} >= {"mit", "bsd", "isc", "apache", "mpl", "zlib", "boost", "unlicense"}


# --- 10 secrets -----------------------------------------------------------------------------------


def test_secrets(spark, make_docs, odd_rows):
    rng = random.Random(9)
    digits = lambda n, a="0123456789abcdef": "".join(rng.choice(a) for _ in range(n))
    mixed = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    secrets = [(3000 + i, f'w w {name} = "{digits(40, alphabet)}" w w') for i, (name, alphabet) in enumerate([("token", "0123456789abcdef"), ("api_key", mixed), ("password", mixed)] * 20)]
    harmless = [(4000 + i, text) for i in range(40) for text in [f"order {digits(16, '0123456789')} shipped", f"commit sha1 {digits(40)} merged", "see example_value_placeholder_1234 here"]]
    rows = odd_rows + secrets + harmless
    got = secret_scan.scan_secrets(make_docs(rows)).collect()
    found = {r.doc_id for r in got if r.secret}
    assert len(found & {i for i, _ in secrets}) >= 58 and not found & {i for i, _ in harmless}
    assert secret_scan.scan_secrets(make_docs([])).count() == 0
    assert secret_scan.scan_secrets(make_docs([(1, "nothing here"), (2, None)])).count() == 0


def test_secrets_of_one_label_score_by_their_own(make_docs):
    rows = [(1, 'w w token = "a1b2c3d4e5f60718293a4b5c6d7e8f9a0b9c8d7e" w w'), (2, "unnamed zq7xk2vb9mw4tr8np3hd here"), (3, "nothing")]
    got = {r.doc_id: (r.score, r.secret) for r in secret_scan.scan_secrets(make_docs(rows)).collect()}
    assert got == {1: (1.0, True), 2: (0.0, False)}


def test_sample_holds_both_labels_once_each(make_docs):
    secret = 'w w token = "a1b2c3d4e5f60718293a4b5c6d7e8f9a0b9c8d7e" w w'
    rows = [(i, f"order 4929{i % 3}56784929567{i % 3} shipped") for i in range(300)] + [(900, secret), (901, secret)]
    found = secret_scan.labelled(secret_scan.with_features(secret_scan.findings(make_docs(rows).withColumn("source", F.lit("s")))))
    got = Counter(r.label for r in secret_scan.sample(found, 4).collect())
    assert got == {0.0: 2, 1.0: 1}
    assert Counter(r.label for r in secret_scan.sample(found).collect()) == {0.0: 3, 1.0: 1}


def test_assigned_values_are_findings(make_docs):
    texts = [
        'a password = "Tr0ub4dor&3" b', "a pwd=hunter2, b", "x PASSWD: P@ssw0rd!2024 y", "api_key='qwzxkvbnmplkjhgfdsa' z", 'secret: "correct horse battery staple" y',
        "auth_token =kq!vz#mw y", "pwd=abc", "level: somewhat plain prose = other", "token => `ab cd ef` z", 'token = "a1b2c3d4e5f60718293a4b5c6d7e8f9a0b9c8d7e"',
    ]
    found = secret_scan.findings(make_docs(list(enumerate(texts))))
    expected = {
        (0, 3, "Tr0ub4dor&3"), (1, 1, "hunter2"), (2, 2, "P@ssw0rd!2024"), (3, 0, "qwzxkvbnmplkjhgfdsa"), (4, 1, "correct horse battery staple"),
        (5, 1, "kq!vz#mw"), (8, 2, "ab cd ef"), (9, 2, "a1b2c3d4e5f60718293a4b5c6d7e8f9a0b9c8d7e"),
    }
    assert rows_of(found, "doc_id", "at", "value") == Counter(expected)


# --- nothing runs per row in Python where only DataFrame operations are asked for -----------------


@pytest.mark.parametrize("name", ["op6_exact_dedup", "op9_license_scan", "op10_secret_scan"])
def test_native_plans(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|NestedLoop|Cartesian", plan)
