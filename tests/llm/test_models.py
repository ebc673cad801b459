"""Quality, toxicity, near duplicates, tokens, search and the pipeline."""

from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pitspark.llm import ann, components, crf, ngram_join, quality, token_codec, token_files, toxicity
from pitspark.llm.boosting import fit_trees
from pitspark.llm.queries import END_ID, QUERIES, tokenizer_path
from pitspark.llm.shingles import choose_bands
from pitspark.llm.token_codec import (
    BLOCK, Coded, _read_order0, _unpack_alphabet, decode_blocks, encode_blocks, ids_crc32, join_crc32,
)

SF = "/root/testdata/sf0.01"


def rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# --- near duplicates

def near_texts():
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(400)]
    texts = brute.awkward_texts()
    for i in range(40):
        w = list(base)
        for j in rng.choice(400, size=int(rng.integers(1, 7)), replace=False):
            w[j] = f"e{i}_{j}"
        texts.append((100 + i, " ".join(w)))
    return texts + [(200 + i, " ".join(base)) for i in range(15)]


@pytest.mark.parametrize("block_docs", [512, 8])
def test_near_duplicates_equal_brute_force(spark, block_docs):
    texts = near_texts()
    got = ngram_join.near_duplicates(brute.docs(spark, texts), block_docs=block_docs)
    assert rows(got, "doc_id", "class_id", "n_links") == Counter(brute.near_classes(texts))


def unit_doc(node, elements):
    grams = np.array(sorted(elements), np.uint64)
    return node, 1, grams, np.array([7], np.int64), np.array([70], np.int64)


@pytest.mark.parametrize("across", [False, True])
def test_unit_keeps_chains_together(across):
    rng = np.random.default_rng(5)
    for length in (3, 5, 10, 50):
        for _ in range(20):
            order = rng.permutation(length) + 1
            docs = [unit_doc(int(v), range(10 * i, 10 * i + 100)) for i, v in enumerate(order)]
            docs.append(unit_doc(900, range(10_000, 10_100)))
            # 90 of 110 elements are common to neighbours, 80 of 120 to the next
            left, right = (docs[::2], docs[1::2]) if across else (docs, [])
            links, root = ngram_join.verify_unit(7, left, right, 0.8)
            got = dict(zip((d[0] for d in left + right), root))
            assert {got[int(v)] for v in order} == {1} and got[900] == 900
            assert links.sum() == 2 * (length - 1)


def test_chains_of_near_duplicates_equal_brute_force(spark):
    texts = []
    for c, length in enumerate([3] * 12 + [5] * 6 + [12] * 3):
        base = [f"c{c}w{i}" for i in range(200 + 12 * length)]
        texts += [(1000 * c + i, " ".join(base[12 * i:12 * i + 200])) for i in range(length)]
    for block_docs in (512, 4):
        got = ngram_join.near_duplicates(brute.docs(spark, texts), block_docs=block_docs)
        assert rows(got, "doc_id", "class_id", "n_links") == Counter(brute.near_classes(texts))


def test_distinct_documents(spark):
    texts = near_texts()
    docs = brute.docs(spark, texts)
    kept = ngram_join.distinct_documents(docs)
    classes = {c for (_, c, _), (_, t) in zip(brute.near_classes(texts), texts) if t and c is not None}
    got = [r for r in kept.collect()]
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in got if r.text and r.doc_id is not None) == sorted(classes)
    assert sum(not r.text for r in got) == sum(not t for _, t in texts)
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_bands_reach_the_recall():
    for s, recall in ((0.8, 0.999), (0.8, 0.9), (0.5, 0.95)):
        b, r = choose_bands(s, recall)
        assert 1 - (1 - s**r) ** b >= recall and b * r <= 256


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(101, 100), (102, 101), (200, 200), (100, 103)]
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    want = {i: 1 for i in range(1, 31)} | {i: 100 for i in range(100, 104)}
    assert {r.node: r.component for r in got.collect()} == want


# --- quality

def test_trees_learn_a_rule_and_walk_like_a_loop():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = fit_trees(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.99
    for row in x[:20]:
        margin = model.base
        for node in model.roots:
            for _ in range(model.depth):
                node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
            margin += model.value[node]
        assert abs(margin - model.margin(row[None])[0]) < 1e-9


def test_trees_without_classes():
    for y in (np.ones(5), np.zeros(0)):
        model = fit_trees(np.zeros((len(y), 3)), y)
        assert np.isfinite(model.score(np.zeros((2, 3)))).all()


def held_out(spark, name, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    return QUERIES[name](spark, SF).where("held_out").join(labels, "doc_id").toPandas()


def test_quality_on_held_out_documents(spark):
    got = held_out(spark, "op3_quality", "quality")
    assert (got.predicted == got.quality).mean() > 0.95


def test_quality_of_awkward_rows(spark):
    labels = [(1, 1), (2, 0), (2, 1), (9, None), (None, 1), (11, 0), (11, 0)]
    model = quality.fit_quality(brute.docs(spark), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = quality.score_quality(brute.docs(spark), model).toPandas()
    assert len(got) == len(brute.awkward_texts()) and got.score.between(0, 1).all()
    assert quality.score_quality(brute.docs(spark).limit(0), model).count() == 0
    none = quality.fit_quality(brute.docs(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.keep_quality(brute.docs(spark), none).count() == len(brute.awkward_texts())


# --- toxicity

def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    lengths = [4, 1, 0, 3]
    odds, trans = np.exp(rng.normal(size=sum(lengths))), rng.normal(size=(2, 2))
    p, _, _ = crf.Chains(np.array(lengths)).marginals(odds, trans)
    at = 0
    for n in lengths:
        e = np.log(odds[at:at + n])
        total, on = 0.0, np.zeros(n)
        for code in range(2**n):
            s = [(code >> i) & 1 for i in range(n)]
            w = np.exp(sum(e[i] * s[i] for i in range(n)) + sum(trans[a, b] for a, b in zip(s, s[1:])))
            total += w
            on += w * np.array(s)
        assert np.allclose(p[at:at + n], on / total)
        at += n


def test_toxicity_on_held_out_documents(spark):
    got = held_out(spark, "op6_toxicity", "toxic")
    assert (got.predicted == got.toxic).mean() > 0.9


def test_toxic_spans_and_awkward_rows(spark):
    texts = [f"some plain words {i} here" + (" you Vileword, indeed" if i % 3 == 0 else "") for i in range(90)]
    docs = brute.docs(spark, [(1000 + i, t) for i, t in enumerate(texts)] + brute.awkward_texts())
    labels = spark.createDataFrame([(1000 + i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == docs.count()
    for r in got:
        bad = r.doc_id is not None and r.doc_id >= 1000 and r.doc_id % 3 == 1000 % 3
        assert r.predicted == int(bad) and 0 <= r.score <= 1
        if bad:
            text = texts[r.doc_id - 1000]
            assert any("Vileword" in text[s.start:s.end] for s in r.spans)
        else:
            assert not r.spans
    none = toxicity.fit_toxicity(docs, labels.limit(0))
    assert toxicity.score_toxicity(docs.limit(3), none).count() == 3


# --- tokens

@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, BLOCK])
def test_codec_round_trip(n):
    rng = np.random.default_rng(n)
    blocks = [
        rng.integers(0, 65536, n), np.full(n // 2, 9), np.arange(n) % 3, rng.zipf(1.3, n).clip(0, 65535),
        np.full(n, 65535), np.arange(n),
    ]
    coded = encode_blocks(blocks)
    for a, b in zip(blocks, decode_blocks(coded)):
        assert np.array_equal(a, b)
    if n == BLOCK:
        assert len(coded[1].payload) < n // 20 and len(coded[2].payload) < n // 20


def test_damaged_block_is_found():
    c = encode_blocks([np.arange(1000) % 50])[0]
    payload = bytearray(c.payload)
    payload[40] ^= 1
    with pytest.raises((ValueError, IndexError)):
        decode_blocks([Coded(c.n_ids, c.alphabet, bytes(payload), c.crc32)])


def test_ids_under_order_0_have_their_own_stream():
    """Their counts are in the alphabet and their number of words in front, so that they are read without the model."""
    ids = np.random.default_rng(1).integers(0, 300, BLOCK)
    c = encode_blocks([ids, ids[:0]])[0]
    alphabet, counts = _unpack_alphabet(c.alphabet)
    assert np.array_equal(alphabet, np.unique(ids)) and len(counts) == len(alphabet)
    words = np.frombuffer(c.payload, "<u2")
    read = _read_order0([words[1:1 + words[0]]], counts[None, :])[0, :counts.sum()]
    assert np.array_equal(np.bincount(read, minlength=len(counts)), counts)
    left = iter(ids)
    assert all(any(x == y for y in left) for x in alphabet[read])  # in the order of the ids


def test_weights_of_a_block_come_between_its_streams():
    """A byte for each outcome that occurs, so that no weights are learnt in step."""
    ids = np.random.default_rng(2).zipf(1.3, BLOCK).clip(0, 999)
    c = encode_blocks([ids])[0]
    words = np.frombuffer(c.payload, "<u2")
    rounded, taken = token_codec._unpack_weights(words[1 + words[0]:])
    weights = token_codec._counts(rounded).reshape(token_codec.STATES, 4)
    n0 = _unpack_alphabet(c.alphabet)[1].sum()
    assert 0.9 * n0 <= weights[:, 2].sum() <= n0 and 0.9 * BLOCK <= weights.sum() <= BLOCK
    assert not weights[:, 3].any() and taken <= 8 + 48
    every = np.arange(BLOCK + 1)
    least = token_codec._counts(token_codec._rounded(every))
    assert (least <= every).all() and (least[1:] * 1.07 >= every[1:]).all() and np.array_equal(least[:32], every[:32])


def test_runs_of_marks_leave_words_as_they_are():
    encoder = token_files.WordEncoder(open(tokenizer_path(), encoding="utf-8").read())
    texts = ["Word*** word### WORD.%%% (word)...", "«Été»!! été&&& x²** ª** ²³--½", "a\u00d7\u00f7b ((1.5))"]
    odd = ["word''s it***'s ''re", "word<|a|> **", "word** \u03b1", "I\u0307** \u0130**"]
    for text in texts + odd:
        assert list(np.frombuffer(encoder(text), "<u2")) == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert {"word", "été", "***", "###", ".%%%"} <= set(encoder.known) and not any("*" in w for w in encoder.known if w.strip("*"))


def test_words_are_asked_for_once_whatever_marks_follow():
    encoder = token_files.WordEncoder(open(tokenizer_path(), encoding="utf-8").read())
    texts = ["One thing, two things. One; THING: two", "thing! é, È? two", "a,b.c 1.5, x²; 3,4", "so... \"two\", one's; «a», x.", "ſ, İ. ǆ! <|a, ."]
    for text in texts:
        assert list(np.frombuffer(encoder(text), "<u2")) == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert {"one", "thing", "two"} <= set(encoder.known) and not {"One", "thing,", "thing!", "È?"} & set(encoder.known)


def test_latin_texts_have_no_empty_parts():
    encoder = token_files.WordEncoder(open(tokenizer_path(), encoding="utf-8").read())
    texts = ["One. Two,  three\n\nfour!", "\u0152uvre, \u0153uvre.", "\u00c9t\u00e9: \u00e9t\u00e9\t\u00d7 \u00df", "a\u00a0b. c", "a\u00adb. c", "a\x85b\x1cc. d", "", " . "]
    for text in texts:
        assert list(np.frombuffer(encoder(text), "<u2")) == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert {"one", ".", "\u0153uvre", "\u00e9t\u00e9"} <= set(encoder.known) and "" not in encoder.known


def test_joined_checksums():
    ids = np.random.default_rng(0).integers(0, 50_000, 999)
    for cut in (0, 1, 500, 999):
        assert join_crc32(ids_crc32(ids[:cut]), ids_crc32(ids[cut:]), 4 * (999 - cut)) == ids_crc32(ids)


def brute_tokens(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    out, start = [], 0
    for doc, text in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [END_ID])
        out.append((doc, start, len(ids), ids_crc32(ids)))
        start += len(ids)
    return out


def test_tokens_equal_tokenizer(spark):
    texts = brute.awkward_texts()[:-1] + [
        (50, "áb <|endoftext|>x I'LL \x1c 12½ ΑΣ İ\xa0y a\x0bb ﬁ"), (51, "".join(map(chr, range(1, 0x250))))]
    texts = [t for t in texts if t[0] is not None] + [(None, "no id")]
    got = token_files.token_round_trip(brute.docs(spark, texts), tokenizer_path(), END_ID)
    assert rows(got, "doc_id", "start", "n_tokens", "ids_crc32") == Counter(brute_tokens(texts))
    assert token_files.token_round_trip(brute.docs(spark).limit(0), tokenizer_path(), END_ID).count() == 0


# --- search

def test_search_recall_ties_and_awkward_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[300:340] = x[20]
    table = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    table += [(700, None, 1), (720, [0.0] * 16, 1), (740, [float("nan")] * 16, 1), (760, [None] * 16, 1), (None, table[0][1], 1), (780, [1.0], 1), table[0]]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, node int")
    got = ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=20).toPandas()
    s = x.astype(float)
    hit = total = 0
    for q in range(0, 600, 20):
        score = s @ s[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(600), -score))[:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 20 and q not in set(mine.vec_id)
        assert np.allclose(mine.score, s[mine.vec_id] @ s[q], atol=1e-9) and (np.diff(mine.score) <= 1e-12).all()
        hit += len(set(best) & set(mine.vec_id))
        total += 20
        if q == 20:
            assert list(mine.vec_id) == list(range(300, 320))
    assert hit / total >= 0.9
    assert set(got.query_id) == set(range(0, 600, 20))
    assert ann.nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.nearest_neighbours(df.where("vec_id < 3"), F.col("vec_id") % 20 == 0)
    assert few.count() == 2


# --- pipeline

def test_pipeline_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 150")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()] if name != names[-1] else None
        out = stage(spark, docs, SF).cache()
        if name == names[1]:
            want = {c for _, c, _ in brute.near_classes(before)}
            assert {r.doc_id for r in out.select("doc_id").collect()} == want
        if name == names[2]:
            want = {d for d, *_, bad in brute.contamination(before, items) if not bad}
            assert {r.doc_id for r in out.select("doc_id").collect()} == want
        if name == names[-1]:
            texts = [(r.doc_id, r.text) for r in docs.collect()]
            assert sum(r.n_tokens for r in out.collect()) == sum(n for _, _, n, _ in brute_tokens(texts))
        else:
            assert out.columns == docs.columns
        kept[name] = out.count()
        docs = out
    assert kept[names[0]] <= 150 and kept[names[3]] > kept[names[2]]


def test_pipeline_on_awkward_rows(spark, tmp_path):
    folder = str(tmp_path)
    brute.docs(spark).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, brute.passage(20, 60))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() > 0
    brute.docs(spark).limit(0).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


# --- vectors of several lengths

def test_search_takes_each_length_among_its_own(spark):
    rng = np.random.default_rng(11)
    table = {i: rng.standard_normal(8 if i < 30 else 5).tolist() for i in range(50)}
    df = spark.createDataFrame(list(table.items()), "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(df, F.col("vec_id") % 10 == 0, k=60, recall=1.0)
    want = Counter((q, i) for q in range(0, 50, 10) for i in table if i != q and len(table[i]) == len(table[q]))
    assert rows(got, "query_id", "vec_id") == want


def brute_neighbours(table, k):
    """Distinct (id, vector) rows; per query row (query_id, rank, vec_id, score)."""
    rows_in = sorted({(i, tuple(v)) for i, v in table})
    out = []
    for q, v in rows_in:
        if q % 20 == 0:
            near = sorted((-float(np.dot(v, w)), i) for i, w in rows_in if len(w) == len(v) and (i, w) != (q, v))[:k]
            out += [(q, r, i, round(-s, 9)) for r, (s, i) in enumerate(near, 1)]
    return Counter(out)


@pytest.mark.parametrize("seed", range(4))
def test_small_tables_give_all_candidates(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = [3, 15, 18, 21][seed], [4, 9, 0, 40][seed]
    table = [(i, rng.standard_normal(6).tolist()) for i in range(sizes[0])] + [(100 + i, rng.standard_normal(3).tolist()) for i in range(sizes[1])]
    table += [(0, rng.standard_normal(6).tolist()), (0, table[0][1]), (2, table[1][1]), (100, rng.standard_normal(6).tolist())]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=20)
    mine = Counter((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got.collect())
    want = brute_neighbours(table, 20)
    if max(sizes) <= 18:  # no more candidates than asked for
        assert mine == want
    assert Counter((q, r) for q, r, *_ in mine.elements()) == Counter((q, r) for q, r, *_ in want.elements())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokenizer_gives_its_own_ids(spark, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    texts = [(i, t) for i, t in brute.awkward_texts() if i is not None] + [(60, "  two  spaces\n\n and\ttabs  "), (61, "a b c")]
    encoder = token_files.WordEncoder(open(path, encoding="utf-8").read())
    assert (encoder.split is not None) == name.startswith("word")
    for _, text in texts:
        assert list(np.frombuffer(encoder(text), "<u2")) == tokenizer.encode(text or "", add_special_tokens=False).ids
    if encoder.split is None:
        got = token_files.token_round_trip(brute.docs(spark, texts), path, END_ID)
        assert sum(r.n_tokens for r in got.collect()) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)


# --- size of the search's broadcasts, and its scoring of a chunk

def broadcasts_of_search(spark, monkeypatch, df, threshold):
    """Broadcasts that Spark plans for the tables of a search and its result."""
    plans, real, conf = [], ann.materialize, "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)

    def kept(table, name, *more):
        plans.append(table._jdf.queryExecution().executedPlan().toString())
        return real(table, name, *more)

    with monkeypatch.context() as patch:
        patch.setattr(ann, "materialize", kept)
        spark.conf.set(conf, threshold)
        try:
            out = ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=5)
            plans.append(out._jdf.queryExecution().executedPlan().toString())
        finally:
            spark.conf.set(conf, before)
    return sum(p.count("BroadcastExchange") for p in plans)


def test_search_broadcasts_no_table_for_its_size_on_disk(spark, monkeypatch):
    x = np.random.default_rng(2).standard_normal((400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    wanted = broadcasts_of_search(spark, monkeypatch, df, "-1")
    assert broadcasts_of_search(spark, monkeypatch, df, "10m") == wanted


@pytest.mark.parametrize("kind", ["spread", "ties", "clustered", "huge"])
def test_chunk_gives_nearest_of_runs(kind):
    rng = np.random.default_rng(3)
    m, keep = 3000, 6
    x = rng.standard_normal((m, 12))
    if kind == "ties":
        x = np.round(x)
    if kind == "clustered":
        x = np.repeat(rng.standard_normal((30, 12)), 100, axis=0) + 1e-3 * x
    if kind == "huge":
        x *= 1e100
    x[0] = 1
    keys = ann.hash_strings(x, np.linalg.norm(x, axis=1).max(), 3, 7, False)
    depth = rng.integers(0, 9, 200).astype(np.int32)
    depth[:3] = 0, 64, 63

    def table(n, **more):
        lists = pa.ListArray.from_arrays(np.arange(0, 3 * n + 1, 3, dtype=np.int32), pa.array(keys[:n].ravel()))
        return pa.table({"node": np.arange(n), "packed": pa.array([r.tobytes() for r in x[:n]], pa.binary()), "keys": lists, **more})

    least = rng.permutation(m)
    got = ann._score_chunk(keep)(table(200, depth=depth), table(m, least=least)).to_pylist()
    assert [r["node"] for r in got] == list(range(200))
    for r in got:
        i = r["node"]
        d = int(depth[i])
        near = (keys.view(np.uint64) >> np.uint64(min(64 - d, 63))) == (keys[i].view(np.uint64) >> np.uint64(min(64 - d, 63)))
        rows_in = np.flatnonzero(near.any(axis=1)) if d else np.arange(m)
        scores = (x[rows_in] * x[i]).sum(axis=1)
        best = np.lexsort((rows_in, least[rows_in], -scores))[:keep]
        assert [(n["found"], n["least"], -n["below"]) for n in r["near"]] == [
            (rows_in[b], least[rows_in[b]], scores[b]) for b in best]
