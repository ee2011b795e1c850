"""The other corpus operators: brute force, round trips, held-out accuracy and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bizlens.llm import exact_dedup, hmm_lm, mixing, packing, quality, queries, toxicity, url_filter, warc
from bizlens.llm.common import id_bucket
from tests.llm.conftest import documents, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_exact_dedup_odd_rows(spark):
    got = {r["doc_id"]: r for r in rows(exact_dedup.exact_dedup(documents(spark, [None, "", " \n", "a b", "ab ", "ab", "a b"])))}
    assert [got[i]["keep_id"] for i in range(7)] == [2, 2, 2, 3, 3, 3, 6]
    assert got[2]["kept"] and got[3]["kept"] and not got[5]["kept"] and got[4]["group_size"] == 3
    assert got[4]["text_sha256"] == hashlib.sha256(b"ab").hexdigest()
    assert exact_dedup.exact_dedup(documents(spark, []).where("false")).count() == 0


def test_url_filter_rules_and_patterns(spark):
    urls = ["http://a.COM/", "https://example.com/en/x", "http://www.example.com/en/", "http://m.www.example.com/en/?q", "http://x.net/es/1", "net/es/", None, "ftp://net/fr/#a",
            "http://notcom/", "http://casino.org/", "http://xcom.org:80/en/", "http://example.com", "http://com?x=/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string")
    got = rows(url_filter.url_filter(pages, url_filter.rule_table(spark)))
    by = {r["page_id"]: (r["rule"], r["verdict"]) for r in got}
    assert len(got) == len(urls) + 1
    assert by == {0: ("com/", "allow"), 1: ("example.com/en/", "block"), 2: ("www.example.com/en/", "allow"), 3: ("www.example.com/en/", "allow"), 4: ("net/es/", "block"), 5: (None, "allow"),
                  6: (None, "allow"), 7: ("net/fr/", "block"), 8: (None, "allow"), 9: (None, "block"), 10: (None, "allow"), 11: (None, "allow"), 12: (None, "allow")}


def test_warc_salvage():
    import gzip
    made = [warc.record([("WARC-Type", "response"), ("Page-ID", str(i))], f"body {i} ".encode() * 50) for i in range(6)]
    members = [gzip.compress(m) for m in made]
    broken = bytearray(members[2])
    broken[len(broken) // 2] ^= 0xFF
    data = members[0] + members[1] + bytes(broken) + members[3] + b"junk WARC/1.0 junk" + made[4] + members[5][:-9]
    got = list(warc.salvage(data))
    assert [r[4]["page-id"] for r in got if r[0] == "record"] == ["0", "1", "3", "4"]
    gaps = [(r[1], r[2]) for r in got if r[0] == "gap"]
    assert sum(n for _, n in gaps) + sum(r[2] for r in got if r[0] == "record") == len(data)
    assert gaps[0] == (len(members[0] + members[1]), len(broken))


def test_warc_salvage_inside_members():
    import gzip
    made = [warc.record([("WARC-Type", "response"), ("Page-ID", str(i))], random.Random(i).randbytes(3000)) for i in range(5)]
    bad = made[1].replace(b"sha256:", b"sha256:0", 1)
    for level in (0, 6):
        one = gzip.compress(made[0] + bad + made[2], level)
        got = list(warc.salvage(made[4] + one))
        assert [r[4]["page-id"] for r in got if r[0] == "record"] == ["4", "0", "2"]
        assert [r[:4] for r in got if r[0] == "gap"] == [("gap", len(made[4]) + len(made[0]), len(bad), "block digest differs")]
        whole = gzip.compress(b"".join(made[:3]), level)
        crc = bytearray(whole)
        crc[-6] ^= 0xFF
        for data, want in ((bytes(crc), ["0", "1", "2"]), (whole[:-2000], ["0", "1"]), (whole[:7000] + b"\xff" * 50 + whole[7050:], ["0", "1"])):
            got = list(warc.salvage(data + gzip.compress(made[3])))
            ids = [r[4]["page-id"] for r in got if r[0] == "record"]
            assert ids == [*want, "3"] and ("gap", 0, len(data)) in [r[:3] for r in got]


def test_warc_round_trip_odd_rows(spark):
    long = "x" * 120
    pages = spark.createDataFrame([(3, "http://a\nb", long), (1, None, long), (2, "u", None), (5, "u", "short"), (4, "u", "short"), (None, "u", long)], "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows(warc.round_trip(pages)))
    assert got == [("1", 120, "response", None), ("2", 0, "response", None), ("3", 120, "revisit", 1), ("4", 5, "response", None), ("5", 5, "response", None), ("None", 120, "revisit", 1)]


def test_warc_round_trip_fails_on_lost_records(spark, monkeypatch):
    import gzip
    made = [gzip.compress(warc.record([("WARC-Type", "response"), ("Page-ID", str(i))], b"body")) for i in range(2)]
    pages, real = spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string").coalesce(1), warc.write_archives
    for content in (made[0], made[0] + made[1][:20], b""):
        def damaged(rows_, folder, s):
            manifest = real(rows_.coalesce(1), folder, s)
            (name,) = [r["name"] for r in manifest.collect()]
            with open(f"{folder.removeprefix('file:')}/{name}", "wb") as f:
                f.write(content)
            return manifest
        monkeypatch.setattr(warc, "write_archives", damaged)
        with pytest.raises(Exception, match="2 written|gzip member cut off"):
            warc.round_trip(pages).collect()


def test_warc_archives_are_compressed_once(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string")
    folder = f"file:{tmp_path}/archives"
    warc.write_archives(warc.digests(pages), folder)
    got = warc.read_archives(spark, folder).collect()
    assert sorted((r["kind"], r["page_id"], bytes(r["block"] or b"")) for r in got) == [("record", "1", b"a"), ("record", "2", b"b")]


def test_toxicity_on_held_out_rows(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet").select("doc_id", "toxic")
    got = queries.op2(spark, big)
    assert got.count() == spark.read.parquet(f"{big}/documents.parquet").count()
    held = got.where("held_out").join(labels, "doc_id").toPandas()
    toxic, clean = held[held.toxic == 1].score, held[held.toxic == 0].score
    assert np.mean([(t > clean).mean() for t in toxic]) > 0.85
    assert ((clean >= 0.7).mean()) < 0.02


def test_toxicity_recall_at_the_threshold_by_language(spark, sf):
    big = sf.replace("sf0.001", "sf0.1")
    labels, langs = (spark.read.parquet(f"{big}/{t}.parquet").select("doc_id", c) for t, c in (("labels", "toxic"), ("documents", "lang")))
    held = queries.op2(spark, big).where("held_out").join(labels, "doc_id").join(langs, "doc_id").toPandas()
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    recall = toxic.groupby("lang").predicted.mean()
    assert recall["en"] > 0.8 and recall["fr"] > 0.25 and recall["de"] > 0.25 and recall["es"] > 0.1
    assert toxic.predicted.mean() > 0.55 and clean.predicted.sum() <= 3


def test_toxicity_odd_rows(spark):
    docs = documents(spark, [None, "", "you idiot", "fine day", "idiot again"])
    labels = spark.createDataFrame([(2, 1), (3, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in rows(toxicity.toxicity(docs, labels, F.lit(True)))}
    assert len(got) == 5 and got[0]["score"] == got[1]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.toxicity(docs, labels.where("false"), F.lit(True)).count() == 5


def test_quality_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(documents(spark, [None, "", "a b c d e f g h\n a\n\na b c d e f g h\n a"]).drop("_text").withColumn("doc_id", F.col("doc_id") + 10**6))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r for r in rows(quality.quality_rules(docs, spark.read.parquet(f"{sf}/labels.parquet")))}
    for i, t in texts.items():
        w = WORD.findall(t)
        at = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        hit = {k + j for k in range(len(w) - 7) if at[tuple(w[k:k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)), i
        assert r["base_failed"] == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (r["kept"] and r["base_failed"])


def test_packing(spark, sf):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(queries.tokenizer())
    t.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(
        [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " a  b\n c\t d é x <|endoftext|> y "), (10**6 + 2, " a  b\n c\t d é x <|endoftext|> y ")], "doc_id long, text string"))
    ids = {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    got = rows(packing.pack_documents(docs, queries.tokenizer(), packing.Settings(part_pieces=60)))
    seen = Counter()
    for r in got:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and len(part) == r["length"]
        seen[r["doc_id"]] += r["length"]
    assert seen == {i: len(x) * (2 if i == 10**6 + 2 else 1) for i, x in ids.items()}
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        end = 0
        for at, n in sorted(b):
            assert at == end
            end += n
        assert end <= 2048
    assert len(bins) <= 1.03 * sum(map(sum, ([n for _, n in b] for b in bins.values()))) / 2048 + 3


def test_lower_bound_and_best_fit():
    rnd = random.Random(2)
    for _ in range(40):
        lengths = np.array([rnd.choice([rnd.randint(1, 100), rnd.randint(40, 70), rnd.randint(34, 50)]) for _ in range(rnd.randint(1, 60))])
        bins, offsets, filled = packing.best_fit_decreasing(lengths, 100)
        assert packing.lower_bound(lengths, 100) <= len(filled) and filled.max() <= 100
        assert np.array_equal(np.bincount(bins, weights=lengths), filled)
    assert packing.lower_bound(np.array([51] * 10), 100) == 10 and packing.lower_bound(np.array([], int), 100) == 0


def test_hmm_base_scores_and_likelihood(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, "unseenword Ab")], "doc_id long, text string"))
    words = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [None] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    c = Counter(w for i, x in words.items() if not held[i] for w in x)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in rows(hmm_lm.score_texts(docs, id_bucket(F.col("doc_id"), 7) != 2, hmm_lm.Settings(top=300)))}
    for i, x in words.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(x), sum(c[w] > 0 for w in x), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), rel=1e-9)
    test = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)
    rng = np.random.default_rng(1)
    k, symbols = 3, 6
    m = hmm_lm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(symbols), k).T)
    total = 0.0
    for text in np.ndindex(*(5, 5)):  # every path of states, summed one by one
        seq = [*text, 5]
        want = sum(m.start[p[0]] * m.emit[seq[0], p[0]] * math.prod(m.move[p[t - 1], p[t]] * m.emit[seq[t], p[t]] for t in range(1, 3)) for p in np.ndindex(k, k, k))
        (rows_, lengths, mat), = hmm_lm.groups_of([np.array(text)], 5, hmm_lm.Settings(states=k))
        assert math.exp(hmm_lm.forward(m, lengths, mat)[0][0]) == pytest.approx(want)
        total += want
    assert 0 < total < 1


def test_hmm_trains_on_all_texts_until_converged(spark, sf):
    docs, s = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), hmm_lm.Settings(top=5000)
    counts = hmm_lm.word_counts(docs, F.lit(True))
    lex = hmm_lm.lexicon(counts, docs.count(), s)
    encoded = hmm_lm.encode(docs, F.lit(True), lex, "doc_id", "text")
    model, u = hmm_lm.train(encoded, lex, s)
    texts = [np.frombuffer(r["symbols"], np.uint16) for r in encoded.select("symbols").collect()]
    start, move, emit, now = hmm_lm.expect(model, texts, lex.end, s)
    after = hmm_lm.expect(hmm_lm.maximise(start, move, emit, u, s), texts, lex.end, s)[3]
    assert after - now < 1.5e-4 * -now


def test_hmm_forward_equals_the_plain_recursion_to_the_bit():
    rng = np.random.default_rng(3)
    for dtype in (np.float32, np.float64):
        symbols, k = 20_000, 8
        m = hmm_lm.Model(*(x.astype(dtype) for x in (rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(symbols), k).T)))
        texts = [rng.integers(0, symbols - 1, 300 + i % 40).astype(np.uint16) for i in range(512)]
        (_, lengths, mat), = hmm_lm.groups_of(texts, symbols - 1, hmm_lm.Settings())

        def plain():
            ll, a = np.zeros(mat.shape[1]), None
            for t in range(len(mat)):
                b = int((lengths > t).sum())
                a = (m.start if t == 0 else a[:b] @ m.move) * m.emit[mat[t, :b]]
                c = a.sum(1)
                a = a / c[:, None]
                ll[:b] += np.log(c)
            return ll

        assert np.array_equal(plain(), hmm_lm.forward(m, lengths, mat)[0])


def test_hmm_expectation_in_runs_equals_the_plain_recursion_to_the_bit():
    rng = np.random.default_rng(5)

    def plain(m, texts, end, s):
        k = len(m.start)
        start, move, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros((k, end + 1)), 0.0
        for _, lengths, mat in hmm_lm.groups_of(texts, end, s):
            ll, alphas, scales, a = np.zeros(mat.shape[1]), [], [], None
            for t in range(len(mat)):
                b = int((lengths > t).sum())
                a = (m.start if t == 0 else a[:b] @ m.move) * m.emit[mat[t, :b]]
                scales.append(a.sum(1))
                a = a / scales[-1][:, None]
                alphas.append(a)
                ll[:b] += np.log(scales[-1])
            total += ll.sum()
            beta, seen, gammas = np.zeros((0, k), m.emit.dtype), [], []
            for t in range(len(mat) - 1, -1, -1):
                full = np.ones((len(alphas[t]), k), m.emit.dtype)
                if len(beta):
                    x = m.emit[mat[t + 1, :len(beta)]] * beta / scales[t + 1][:, None]
                    move += alphas[t][:len(beta)].T @ x
                    full[:len(beta)] = x @ m.move.T
                beta = full
                gammas.append(alphas[t] * beta), seen.append(mat[t, :len(beta)])
            start += gammas[-1].sum(0)
            for i in range(k):
                emit[i] += np.bincount(np.concatenate(seen), weights=np.concatenate(gammas)[:, i], minlength=end + 1)
        return start, move * m.move, emit.T, total

    for dtype, k, width in ((np.float32, 8, 512), (np.float64, 8, 150), (np.float32, 3, 7)):
        symbols = 3000
        m = hmm_lm.Model(*(x.astype(dtype) for x in (rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(symbols), k).T)))
        texts = [rng.integers(0, symbols - 1, n).astype(np.uint16) for n in [0, 0, 1, 900, *rng.integers(0, 60, 300), *[200] * 260]]
        s = hmm_lm.Settings(states=k, width=width)
        for got, want in zip(hmm_lm.expect(m, texts, symbols - 1, s), plain(m, texts, symbols - 1, s)):
            assert np.array_equal(got, want)


def test_hmm_runs_cover_every_step_once():
    alive = np.array([500] * 200 + [499] * 3 + [7] + [1] * 100_000)
    runs = list(hmm_lm.runs_of(alive))
    assert [t for x, y, _ in runs for t in range(x, y)] == list(range(len(alive)))
    assert all((alive[x:y] == b).all() and (y - x) * b <= hmm_lm.RUN for x, y, b in runs)
    assert len(runs) < 15  # a gather per step would be 100,204


def test_mixing(spark):
    rnd = random.Random(4)
    docs = documents(spark, [(i, "w " * rnd.randint(1, 40)) for i in range(600)] + [(700, None)]).withColumn(
        "source", F.when(F.col("doc_id") < 450, "big").when(F.col("doc_id") < 560, "mid").when(F.col("doc_id") == 599, None).otherwise("small"))
    got = mixing.mix_sources(docs, max_passes=3.0).toPandas()
    assert set(got.doc_id) == set(docs.toPandas().doc_id) and (got[got._copy == 0].groupby("doc_id").size() == 1).all()
    n = {r["doc_id"]: len((r["text"] or "").split()) + 1 for r in docs.collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    tokens = Counter()
    for i, k in n.items():
        tokens[source[i]] += k
    a = mixing.bisect(lambda a: (max(tokens.values()) / min(tokens.values())) ** (1 - a) > 3.0, 0.0, 1.0, 60)
    read = Counter()
    for i in got.doc_id:
        read[source[i]] += n[i]
    for s, t in tokens.items():
        want = t * (max(tokens.values()) / t) ** (1 - a)
        assert abs(read[s] - want) <= max(60, 0.02 * want), s
    even = spark.createDataFrame([("a", 10), ("b", 1000)], "source string, tokens long")
    e = mixing.find_exponent(even, target_entropy=0.9)
    p = np.array([10.0, 1000.0]) ** e
    p /= p.sum()
    assert -(p * np.log2(p)).sum() == pytest.approx(0.9, abs=1e-6)
    assert mixing.mix_sources(docs.where("false")).count() == 0


def test_pipeline_against_its_parts(spark, sf):
    import corpus_pipeline as cp
    from tests.llm.test_jaccard_join import brute
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = cp.drop_toxic(spark, docs, sf)
    toxic = set(docs.toPandas().doc_id) - set(clean.toPandas().doc_id)
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert len(toxic & set(labels[labels.toxic == 0].doc_id)) <= 1
    exact = cp.drop_exact_copies(spark, clean, sf).toPandas()
    seen = {}
    for r in clean.orderBy("doc_id").collect():
        k = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        if k not in seen or len(r["text"]) > len(seen[k][1]):
            seen[k] = (r["doc_id"], r["text"])
    assert set(exact.doc_id) == {i for i, _ in seen.values()}
    near = cp.drop_near_copies(spark, spark.createDataFrame(exact), sf)
    found = brute(list(zip(exact.doc_id, exact.text)))
    assert set(near.toPandas().doc_id) == {i for i, (_, c) in found.items() if i == c}
    mixed = cp.mix(spark, near, sf)
    assert mixed.columns == list(cp.COLUMNS) and set(mixed.toPandas().doc_id) == set(near.toPandas().doc_id)
    out = cp.pack(spark, mixed, sf)
    assert out.groupBy("doc_id", "piece").count().agg(F.sum("count")).first()[0] == out.count() >= mixed.count()
