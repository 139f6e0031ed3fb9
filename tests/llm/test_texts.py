import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import plain
import pytest

from lagwise.llm import jaccard_join as J
from lagwise.llm import language, mixing, partenum, queries_a, queries_c, textbytes, toxicity, training_order, url_filter

RNG = np.random.default_rng(3)
WORDS = [f"w{i}" for i in range(4000)]


def test_shingles_are_those_of_plain_python():
    texts = ["", None, " \n", "one", "One two", "a b c d e", "A B c d e f", "é ü\u00a0x\u3000y z  q\tr", "x " * 3000, "long" * 9000 + " b c d e f"] + [" ".join(RNG.choice(WORDS, int(n))) for n in RNG.integers(0, 60, 50)]
    seen, back = {}, {}
    at = 0
    for first, data, offsets in textbytes.chunks(pa.array(texts), 500):
        assert first == at
        sets, begin = textbytes.shingle_sets(data, offsets)
        for r in range(len(offsets) - 1):
            plain = plain.shingles_of(texts[at + r])
            own = sets[begin[r] : begin[r + 1]].tolist()
            assert len(own) == len(plain) and own == sorted(set(own))
            for s in plain:
                seen.setdefault(s, set(own))
                seen[s] &= set(own)
        at += len(offsets) - 1
    assert at == len(texts) and all(seen.values())  # a shingle has its hash wherever it stands


def corpus():
    passage = list(RNG.choice(WORDS, 60))
    texts = [None, "", "  \n ", "one", "one", "ONE two three four", "one two three four"]
    for n in (6, 9, 14, 30, 80, 200):
        for _ in range(6):
            base = list(RNG.choice(WORDS, n))
            texts.append(" ".join(base))
            for edits in range(0, 5):
                own = list(base)
                for p in RNG.integers(0, n, edits):
                    own[p] = RNG.choice(WORDS)
                texts.append(" ".join(own))
            texts += [" ".join(base[: int(n * f)]) for f in (0.7, 0.78, 0.9)] + [" ".join(passage + base), " ".join(base[: n // 2] + passage + base[n // 2 :])]
    chain = list(RNG.choice(WORDS, 100))
    for k in range(14):
        texts.append(" ".join(chain[k * 4 : k * 4 + 60]))
    order = RNG.permutation(len(texts))
    return [(int(i), texts[i]) for i in order]


@pytest.mark.parametrize("group", [2, 8])
def test_join_finds_every_link(spark, monkeypatch, group):
    monkeypatch.setattr(J, "SMALL_GROUP", group)
    monkeypatch.setattr(J, "BLOCK", 16)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, n long").repartition(3)
    got = {tuple(r) for r in J.near_duplicates(docs).collect()}
    assert got == plain.brute_components(rows)


def test_partenum_never_misses():
    """Every pair that is similar enough shares a signature, whatever counts as common."""
    for _ in range(120):
        n = int(RNG.integers(1, 160))
        base = RNG.integers(0, 2**63, n).astype(np.uint64)
        keep = RNG.random(n) > RNG.random() * 0.2
        other = np.concatenate((base[keep], RNG.integers(0, 2**63, int(RNG.integers(0, n // 6 + 1))).astype(np.uint64)))
        a, b = np.unique(base), np.unique(other)
        both = len(np.intersect1d(a, b))
        if not len(b) or both * 100 < 75 * (len(a) + len(b) - both):
            continue
        u, v = (J.opened(x) for x in J.sketches(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])))
        assert J.may_be_similar(u, v, Fraction(1, 7))
        known = np.unique(RNG.choice(np.concatenate([partenum.Signer(Fraction(3, 4), None).emit(x, np.array([0, len(x)]), True)[0] for x in (a, b)]), 20))
        for common in (None, (known, np.full(len(known), 9))):
            one, two = (set(partenum.Signer(Fraction(3, 4), common).emit(x, np.array([0, len(x)]))[0].tolist()) for x in (a, b))
            assert one & two


def test_join_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in J.near_duplicates(docs).collect())
    assert got == [(-1, 0, -1), (-1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2)]
    assert J.near_duplicates(docs.limit(0)).count() == 0
    full = spark.createDataFrame([(3, "a b c d e f", "en", "s", 1), (1, "A b c d e f", "en", "s", 1), (3, "a b c d e f", "en", "s", 1), (4, "", "en", "s", 1), (4, "", "en", "s", 1), (5, "q r s t u", None, None, None), (5, "q r s t u", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in J.drop_near_duplicates(full).collect()) == [1, 4, 4, 5]


def test_mix_meets_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rows = [(i, ["a", "b", "Z", None, "é"][int(k)], " ".join(RNG.choice(WORDS, int(n)))) for i, (k, n) in enumerate(zip(RNG.choice(5, 400, p=[0.6, 0.2, 0.1, 0.05, 0.05]), RNG.integers(0, 50, 400), strict=True))] + [(400, "a", None), (None, "b", "x y"), (401, "empty", "")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, text string, size string").repartition(4)
    quality = spark.createDataFrame([(i, 2.0) for i in range(0, 400, 3)] + [(0, 1.0)], "key long, weight double")
    one, two = (sorted(map(str, mixing.mix(docs.repartition(n), quality=quality).collect())) for n in (4, 7))
    assert one == two
    size, target = plain.mix_targets(rows, (3, 1, 2), 1.5, 2.0)
    taken, biggest = defaultdict(int), defaultdict(int)
    out = mixing.mix(docs, quality=quality).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.taken <= 2 * r.size and r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
        taken[r.source] += r.taken
        biggest[r.source] = max(biggest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= biggest[s] / 2 + 1e-6 for s in size)
    assert mixing.mix(docs.limit(0)).count() == 0
    copies = defaultdict(int)
    for r in mixing.repeat_mixed(docs).collect():
        copies[r.source] += len(plain.words_of(r.text))
        assert r["size"] == "clash"
    assert all(abs(copies[s] - target[s]) <= biggest[s] / 2 + 1e-6 for s in size)


@pytest.mark.parametrize(("share", "n"), [(1.495, 1), (0.485, 1), (0.5, 3)])
def test_equal_rows_are_taken_as_far_as_they_fit(spark, share, n):
    """1,000 rows of which most are equal, in every column that orders them."""
    docs = spark.createDataFrame([(i % n if i < 990 else None, "s", "a b c d") for i in range(1000)], "doc_id long, source string, text string").repartition(5)
    out = mixing.mix(docs, share=share).collect()
    assert len(out) == 1000 and all(r.taken in (0, 4, 8) for r in out)
    assert abs(sum(r.taken for r in out) - min(share, 2.0) * 4000) <= 2
    assert abs(4 * mixing.repeat_mixed(docs, share=share).count() - min(share, 2.0) * 4000) <= 2


def test_heavier_documents_come_first(spark):
    docs = spark.createDataFrame([(i, "s", "a b c d") for i in range(2000)], "doc_id long, source string, text string")
    quality = spark.createDataFrame([(i, 8.0) for i in range(1000)], "key long, weight double")
    picked = [r.key for r in mixing.mix(docs, share=0.5, quality=quality).collect() if r.picked]
    assert 995 <= len(picked) <= 1005 and np.mean(np.array(picked) < 1000) > 0.75


def test_urls(spark):
    rows = [
        (1, "https://Example.COM/en/x?y", "example.com", "/en/x", "example.com/en/", "block"), (2, "http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"), (3, "http://a.net/es/1#t", "a.net", "/es/1", "net/es/", "block"),
        (4, "http://xcom/", "xcom", "/", None, "allow"), (5, "http://a.org/best-casino?", "a.org", "/best-casino", None, "block"), (6, "http://a.org/casinox", "a.org", "/casinox", None, "allow"), (7, "http://a.org/win/win", "a.org", "/win/win", None, "allow"),
        (8, "http://a.org/win/free", "a.org", "/win/free", None, "block"), (9, None, "", "", None, "allow"), (10, "", "", "", None, "allow"), (11, "casino", "", "", None, "block"), (12, "http://b.com/casino", "b.com", "/casino", "com/", "allow"),
        (13, "x://y://z/q", "y:", "//z/q", None, "allow"), (14, "http://h?" + "a" * 100_000 + "&porn", "h", "", None, "block"), (14, "http://h?" + "a" * 100_000 + "&porn", "h", "", None, "block"),
    ]
    df = spark.createDataFrame([(r[0], r[1], "clash") for r in rows], "page_id long, url string, host string")
    out = url_filter.judge_urls(df, url_filter.Vocabulary(rules=queries_a.RULES)).collect()
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in out} == {(r[0], *r[2:]) for r in rows}
    assert len(out) == len(rows) and url_filter.judge_urls(df.limit(0), url_filter.Vocabulary()).count() == 0
    for t in ("ab", "xab", "ab-cd", "abcd", "-ab-", "", None):
        a = url_filter.automaton({"ab": 2, "cd": 1})
        strict, soft = ({m for m in re.findall(r"(?<![a-z0-9])(ab|cd)(?![a-z0-9])", t or "") if (m == "ab") == kind} for kind in (True, False))
        assert url_filter.term_hits(a, t) == (len(strict), len(soft), 2 * len(strict) + len(soft))


def test_vocabulary_and_rules_from_tables(spark, monkeypatch):
    terms = spark.createDataFrame([("Spam", 2), ("meh", 1), ("meh", None), (None, 3), ("so", 1), ("what", None)], "term string, weight int")
    rules = spark.createDataFrame([(f"h{i}.org", f"/{i % 7}", "block" if i % 2 else "allow") for i in range(3000)] + [(None, "/", "block"), ("org", None, "block")], "host string, path string, verdict string")
    v = url_filter.Vocabulary.of(terms, rules)
    urls = [f"http://a.h{i}.org/{j}/spam" for i in range(0, 3000, 251) for j in range(7)] + ["http://x.net/meh/so", "http://x.net/meh/meh", "http://x.net/what-meh", "x/SPAM"]
    plain = {}
    for u in urls:
        host, _, path = u.partition("://")[2].partition("/")
        path = "/" + path if "://" in u else ""
        fits = [r for r in v.rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.label), r.verdict == "block"), default=None)
        found = set(re.findall(r"(?<![a-z0-9])(spam|meh|so|what)(?![a-z0-9])", u.lower()))
        plain[u] = (best and best.label, best.verdict if best else "block" if sum(v.terms[t] for t in found) >= 2 else "allow")
    out = url_filter.judge_urls(spark.createDataFrame([(u,) for u in urls], "url string"), v).collect()
    assert {r.url: (r.rule, r.verdict) for r in out} == plain and {x for _, x in plain.values()} == {"allow", "block"}
    monkeypatch.setattr(url_filter, "MOST", 10)
    with pytest.raises(ValueError):
        url_filter.Vocabulary.of(rules=rules)
    assert len(url_filter.listed_terms()) > 100


def test_machine_learns_what_only_pairs_say():
    x = RNG.integers(0, 2, (4000, 4)).astype(np.float32)
    y = (x[:, 0] * x[:, 1]).astype(float)
    m = toxicity.fit(x, y, np.arange(4))
    s = m.score(x)
    assert s[y == 1].min() > 0.5 > s[y == 0].max() and m.score(np.array([[1, 1, 0, 0]]))[0] > 0.5
    v = m.factors
    one = np.array([[1, 0, 1, 1]])
    pairs = sum(v[i] @ v[j] for i, j in ((0, 2), (0, 3), (2, 3)))
    assert m.logits(one)[0] == pytest.approx(m.bias + m.weights[[0, 2, 3]].sum() + pairs)


def test_toxicity_holds_out_and_takes_odd_rows(spark):
    texts = [" ".join(RNG.choice(WORDS[:300], int(n))) + (" idiot scum" if i % 5 == 0 else "") for i, n in enumerate(RNG.integers(5, 80, 600))]
    docs = spark.createDataFrame([(i, t, 9.0) for i, t in enumerate(texts)] + [(1000, None, 0.0), (1001, "", 0.0), (None, "idiot scum", 0.0), (1002, "x " * 50_000 + "Idiot, scum!", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)] + [(0, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    m = toxicity.learn(docs, labels.filter(~queries_c.held_out(labels["doc_id"])))
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, m).collect()}
    assert np.mean([got[i] == (i % 5 == 0) for i in range(600)]) > 0.95
    assert (got[1000], got[1001], got[None], got[1002]) == (0, 0, 1, 1)
    flipped = labels.withColumn("toxic", queries_c.held_out(labels["doc_id"]).cast("int"))
    again = toxicity.learn(docs, flipped.filter(~queries_c.held_out(flipped["doc_id"])))
    assert not any(r.predicted for r in toxicity.score(docs, again).collect())  # what is held out teaches nothing
    none = toxicity.learn(docs, labels.limit(0))
    assert toxicity.score(docs.limit(2), none).first().predicted == 0 and toxicity.score(docs.limit(0), m).count() == 0


SOUNDS = {"en": "the and ing tion with that", "de": "der und schen ung nicht ich", "fr": "les des eau que ment ére"}


def say(lang, n):
    return " ".join("".join(RNG.choice(SOUNDS[lang].split(), 2)) for _ in range(n))


def test_language_fuses_its_evidence(spark):
    rows = [(i, say(lang, 40), lang, None, "", f"h{lang}", f"h{lang}") for i, lang in enumerate(list(SOUNDS) * 60)]
    rows += [(900, say("de", 60), "en", None, "", "hen", "hen"), (901, "A.", "fr", None, "", "hfr", "hfr"), (902, None, "fr", None, "", "hfr", "hfr"), (903, "123 !?", "en", None, None, None, None), (904, say("fr", 30), None, None, None, None, None), (905, "中文 測試 文字 " * 30, None, None, "", "x", "x")]
    rows += [(906, rows[0][1], *rows[0][2:]), (906, rows[0][1], *rows[0][2:])]
    df = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, tld string, domain string, host string")
    got = {r.id: r for r in language.identify(df).collect()}
    assert all(got[i].lang == lang and got[i].kept for i, lang in enumerate(list(SOUNDS) * 60))
    assert got[900].lang == "de" and (got[901].lang, got[901].kept) == ("fr", True)  # strong text wins, weak text yields
    assert [(got[k].lang, got[k].kept) for k in (902, 903, 905)] == [("und", False)] * 3 and got[904].lang == "fr"
    assert language.identify(df.limit(0)).count() == 0


def test_evidence_of_pages(spark):
    html = "<html lang='DE-at'><script>x</script><p>Hallo <b>Welt</b><!-- no --></p>"
    rows = spark.createDataFrame([(1, "https://Blog.A.example.com/fr/x", html), (2, "http://shop.it?q", "<p>x"), (3, None, None)], "page_id long, url string, html string")
    got = {r.id: r for r in language.page_rows(rows, rows["page_id"]).collect()}
    assert (got[1].declared, got[1].suffix, got[1].tld, got[1].domain, got[1].host) == ("de", "fr", "com", "example.com", "blog.a.example.com") and "x" not in got[1].text and "Welt" in got[1].text
    assert (got[2].declared, got[2].suffix) == (None, "it") and got[3].declared is None and got[3].text is None


def test_permutation():
    for n in (1, 2, 3, 5, 64, 65, 1000):
        p = training_order.permute(np.arange(n), n, 7)
        assert sorted(p.tolist()) == list(range(n)) and (training_order.permute(np.arange(n), n, 7) == p).all()
    a, b = (training_order.permute(np.arange(1000), 1000, k) for k in (1, 2))
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(a, np.arange(1000))[0, 1]) < 0.2


def test_shards_hold_every_sequence(spark, tmp_path):
    """Texts come back whole by the index, slots from any on, and the files by plain seeks."""
    from tokenizers import Tokenizer

    from lagwise.llm import tokens

    rows = [(i, "word " * int(n)) for i, n in enumerate(RNG.integers(0, 120, 90))] + [(None, None), (7, ""), (8, "long " * 4000), (3, "same"), (3, "same")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, slot string").repartition(4)
    n = training_order.write_shards(docs, f"{tmp_path}/s", 5, length=50, per_shard=16, end_id=3)
    got = {r.slot: bytes(r.ids) for r in training_order.read_slots(spark, f"{tmp_path}/s").collect()}
    index = spark.read.parquet(f"{tmp_path}/s/index").collect()
    assert sorted(got) == list(range(n)) == sorted(r.slot for r in index)
    whole = Tokenizer.from_file(tokens.vocabulary_path())
    want = Counter((i, tuple(whole.encode(t or "", add_special_tokens=False).ids + [3])) for i, t in rows)
    pieces = defaultdict(list)
    for r in index:
        ids = np.frombuffer(got[r.slot], "<u2")
        assert len(ids) == 50 and (ids[r["count"] :] == 3).all() and sum(d["count"] for d in r.docs) == r["count"] and r.offset == r.slot % 16 * 100
        for d in r.docs:
            pieces[d.doc_id].append((d.start, tuple(ids[d["at"] : d["at"] + d["count"]].tolist())))
    for key in {i for i, _ in rows}:
        own = sorted(pieces[key])
        assert sum(len(p) for _, p in own) == sum(len(t) * k for (i, t), k in want.items() if i == key)
        if sum(k for (i, _), k in want.items() if i == key) == 1:
            assert (key, sum((p for _, p in own), ())) in want
    some = training_order.read_slots(spark, f"{tmp_path}/s", 20, 45).collect()
    assert {r.slot: bytes(r.ids) for r in some} == {t: got[t] for t in range(20, 45)} and all(r.shard == r.slot // 16 for r in some)
    files = sorted((tmp_path / "s/shards").glob("part-*"))
    assert len(files) == -(-n // 16) and all(f.stat().st_size == min(16, n - 16 * k) * 100 + 1 for k, f in enumerate(files))
    with files[1].open("rb") as f:
        assert list(training_order.read_records(f, 100, 4, 9)) == [got[t] for t in range(20, 29)]
    assert training_order.write_shards(docs, f"{tmp_path}/again", 5, length=50, per_shard=16, end_id=3) == n
    assert {r.slot: bytes(r.ids) for r in training_order.read_slots(spark, f"{tmp_path}/again").collect()} == got
    assert training_order.write_shards(docs.limit(0), f"{tmp_path}/e") == 0 and training_order.read_slots(spark, f"{tmp_path}/e").count() == 0


def test_every_language_is_sampled_and_stray_tags_learn_nothing(spark):
    none = (None, None, None, None)
    rows = [(i, say(lang, 40), lang, *none) for i, lang in enumerate(list(SOUNDS) * 100)] + [(900 + i, " ".join(["zbor", "vrij", "pluk"][k] for k in RNG.integers(0, 3, 400)), "nl", *none) for i in range(5)]
    rows += [(950, "Hm.", "xx", *none)] + [(960 + i, "中文 測試 文字 " * 30, None, *none) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, tld string, domain string, host string")
    m = language.learn(df, sample=30)
    assert m.names == ("de", "en", "fr", "nl", "und") and (np.ptp(m.table[:-1], axis=1) > 3).all()
    got = {r.id: r for r in language.identify(df, model=m).collect()}
    assert all((got[960 + i].lang, got[960 + i].kept) == ("und", False) for i in range(20)) and all(got[900 + i].lang == "nl" for i in range(5))
    assert all(got[i].lang == lang for i, lang in enumerate(list(SOUNDS) * 100))


def test_more_than_32_languages_are_told_and_rare_ones_keep_their_declaration(spark):
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    tags = [f"q{x}" for x in letters] + [f"z{x}" for x in letters[:14]]
    own = {tag: ["".join(RNG.choice(letters, 6)) for _ in range(12)] for tag in tags}
    none = (None, None, None, None)
    rows = [(100 * k + i, " ".join(RNG.choice(own[tag], 100)), tag, *none) for k, tag in enumerate(tags) for i in range(8 if k else 9)]
    rows += [(9000 + k, " ".join(RNG.choice(own[tag], 60)), None, *none) for k, tag in enumerate(tags)] + [(9900, "Привет мир", "ru", *none), (9901, "123 !?", "ru", *none), (9902, "中文 測試 " * 30, "und", *none)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, tld string, domain string, host string")
    got = {r.id: r for r in language.identify(df).collect()}
    assert all((got[100 * k].lang, got[100 * k].kept) == (tag, True) and got[9000 + k].lang == tag for k, tag in enumerate(tags))
    assert [(got[k].lang, got[k].kept) for k in (9900, 9901, 9902)] == [("ru", True), ("und", False), ("und", False)]
    assert [r.kept for r in language.identify(df.filter("id >= 9900"), accepted=("en",)).collect()] == [False] * 3
