"""The pipeline, language identification and toxicity against plain versions, on small tables."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import plain
import pytest

import corpus_pipeline
from lagwise.llm import language, queries_a, queries_c, toxicity

RNG = np.random.default_rng(11)
SOUNDS = {"aa": ["ka", "lo", "mi", "ta", "ru"], "bb": ["schn", "ung", "heit", "pf", "er"], "cc": ["çã", "ões", "nh", "lh", "ei"]}


def prose(lang, n):
    return " ".join("".join(RNG.choice(SOUNDS[lang], int(k))) for k in RNG.integers(1, 4, n))


def tables(folder, spark, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def small_corpus():
    global RNG
    RNG = np.random.default_rng(11)  # the same rows in whatever order tests run
    docs, labels = [], []
    for i in range(150):
        lang = ["aa", "bb", "cc"][i % 3]
        text = prose(lang, int(RNG.integers(8, 60)))
        toxic = i % 5 == 0
        if toxic:
            text += " vile scum " + prose(lang, 4)
        docs.append((i, text, lang if i % 7 else None, f"s{i % 4}" if i % 11 else None, len(text)))
        labels.append((i, i % 2, int(toxic)))
    docs += [(200 + i, docs[i][1] + (" again" if i % 2 else ""), docs[i][2], docs[i][3], 0) for i in range(1, 30, 3)]
    docs += [(300, None, "aa", "s0", 0), (301, "", None, None, 0), (302, "12 34 !!", "bb", "s1", 0), (303, prose("bb", 3000), "bb", "s2", 0)]
    return docs, labels


def rows_of(docs):
    return [{"id": d, "text": t, "declared": lang, "suffix": None, "tld": "", "domain": s, "host": s} for d, t, lang, s, _ in docs]


def test_language_is_the_plain_posterior(spark):
    docs, _ = small_corpus()
    rows = rows_of(docs)
    for i, r in enumerate(rows):
        r["suffix"] = ["xx", "yy", None][i % 3]
        r["host"] = f"h{i % 9}.{r['domain']}"
        r["tld"] = ["com", "net"][i % 2] if r["domain"] else None
    rows.append({"id": 900, "text": "zq zq", "declared": "zz", "suffix": None, "tld": None, "domain": None, "host": None})
    df = spark.createDataFrame([(r["id"], r["text"], r["declared"], r["suffix"], r["tld"], r["domain"], r["host"], "clash") for r in rows], "id long, text string, declared string, suffix string, tld string, domain string, host string, lang string").repartition(3)
    want = plain.identify(rows)
    got = language.identify(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.lang == want[r.id][0] and r.confidence == pytest.approx(want[r.id][1], abs=1e-5)
        assert r.kept == (r.lang != language.NONE and r.confidence >= language.CONFIDENCE)
    assert language.identify(df.limit(0)).count() == 0


def test_equal_likelihoods_go_to_the_first_language(spark):
    same = prose("aa", 2000)
    rows = [{"id": i, "text": same, "declared": lang, "suffix": None, "tld": None, "domain": None, "host": None} for i, lang in enumerate(("aa", "bb"))]
    rows.append({"id": 2, "text": "ka lo", "declared": None, "suffix": None, "tld": None, "domain": None, "host": None})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, text string, declared string, suffix string, tld string, domain string, host string")
    assert {r.id: r.lang for r in language.identify(df).collect()}[2] == "aa" == plain.identify(rows)[2][0]


def test_rejected_documents_go_and_others_stay_as_they_are(spark):
    docs, _ = small_corpus()
    docs += [docs[0], (None, "ka lo mi", "aa", None, 0), (None, None, None, None, None)]
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(3)
    want = plain.identify([{**r, "id": i} for i, r in enumerate(rows_of(docs))])
    kept = Counter((*d, "c") for i, d in enumerate(docs) if want[i][0] != language.NONE and want[i][1] >= language.CONFIDENCE)
    assert Counter(map(tuple, language.drop_rejected(df).collect())) == kept
    assert language.drop_rejected(df.limit(0)).count() == 0


def test_query_three_is_the_plain_formula(spark, tmp_path):
    docs, labels = small_corpus()
    tables(tmp_path, spark, docs, labels)
    machine = queries_c.toxicity_machine(spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    got = {r.doc_id: r for r in queries_c.op3_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs) and len(machine.terms) > 10
    for d, text, *_ in docs:
        assert got[d].score == pytest.approx(plain.toxic_score(machine, text), abs=1e-6)
        assert got[d].predicted == int(got[d].score >= 0.3) and got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
    assert np.mean([got[d].predicted == y for d, _, y in labels if not got[d].held_out]) > 0.95


def test_machine_finds_a_pair_that_is_harmless_alone(spark):
    """Either term has the label rate of all texts; only both together tell."""
    fill = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(2400):
        a, b = RNG.random() < 0.3, RNG.random() < 0.3
        toxic = (a and b) or (not a and not b and RNG.random() < 0.43)
        words = [*RNG.choice(fill, 15), *["zamzam"] * a, *["quxqux"] * b]
        docs.append((i, " ".join(RNG.permutation(words))))
        labels.append((i, int(toxic)))
    probe = [(10_000 + 100 * k + i, " ".join([*RNG.choice(fill, 15), *own])) for k, own in enumerate((["zamzam", "quxqux"], ["zamzam"], ["quxqux"])) for i in range(100)]
    df = spark.createDataFrame(docs + probe, "doc_id long, text string").repartition(3)
    machine = toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    score = {r.doc_id: r.score for r in toxicity.score(df.filter("doc_id >= 10000"), machine).collect()}
    both, one, other = (np.array([score[10_000 + 100 * k + i] for i in range(100)]) for k in range(3))
    assert np.median(both) > 0.8 and np.median(one) < 0.2 and np.median(other) < 0.2


def test_pipeline_is_the_plain_stages(spark, tmp_path):
    docs, labels = small_corpus()
    tables(tmp_path, spark, docs, labels)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    want = plain.identify(rows_of(docs))
    kept = [d for d in docs if want[d[0]][0] != language.NONE and want[d[0]][1] >= language.CONFIDENCE]
    machine = queries_c.toxicity_machine(spark.createDataFrame(kept, "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path))
    kept = [d for d in kept if plain.toxic_score(machine, d[1]) < toxicity.THRESHOLD]
    first = {i: c for i, _, c in plain.brute_components([(d[0], d[1]) for d in kept])}
    kept = [d for d in kept if first[d[0]] == d[0]]
    quality = {d: queries_a.QUALITY_WEIGHT.get(q, 1.0) for d, q, _ in labels}
    copies = plain.mix_copies([(d[0], d[3], d[1]) for d in kept], quality, **queries_a.MIX)
    pieces = Counter((d[0], *p) for d in kept for _ in range(copies[d[0]]) for p in plain.pieces_of(d[1]))
    assert 20 < len(kept) < len(docs) - 20
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 2048
    assert len(places) <= -(-sum(r.length for r in got) // 2048) + 1
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "toxicity", "jaccard", "mixing", "packing"]


def test_stages_take_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, columns of other names, and no rows, through each stage."""
    docs, labels = small_corpus()
    tables(tmp_path, spark, docs, labels)
    odd = [(None, None, None, None, None, "x"), (None, "ka lo mi ka lo mi", None, None, None, "x"), (5, "ka lo mi ka lo mi", "aa", "s", 1, None), (5, "ka lo mi ka lo mi", "aa", "s", 1, None), (6, "", "aa", "s", 0, "y")] + [(*d, "z") for d in docs]
    df = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, size string")
    for name, stage in corpus_pipeline.STAGES:
        for given in (df, df.limit(0)):
            out = stage(spark, given, str(tmp_path))
            assert name == "packing" or out.columns == df.columns
            assert (out.count() == 0) == (given is not df), name
