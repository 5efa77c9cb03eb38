"""Training-data operators against plain Python on small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from fieldscope.llm import decontaminate, jaccard, langid, lines, mixing, quality, tokens, urls
from fieldscope.llm.common import shared_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and erin thal onder stal rebin kor vant ulmo serif quon delta mira tolk hest wyn parn osk".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n)) if n else ""


@pytest.fixture(scope="module")
def documents():
    rng = np.random.default_rng(4)
    rows, base = [], [prose(rng, 60) for _ in range(6)]
    for i in range(60):
        text = base[i % 6].split(" ")
        for at in rng.integers(0, 60, i // 12):
            text[at] = "x" + str(i)
        rows.append((i, " ".join(text) if i % 3 else prose(rng, int(rng.integers(1, 90))), ["en", "de", None][i % 3], f"src{i % 4}", 9))
    long = " ".join(f"w{i}" for i in range(30000))
    rows += [(60, None, None, None, None), (61, "", "en", "src1", 0), (62, " \n\t ", "en", "src1", 3), (63, "One", "de", None, 3), (64, "one", "de", None, 3), (65, long, "en", "src0", 1), (66, long + " end", "en", "src0", 1), (67, "Ünï ΣΣ 12 ¿ 中文 don't", None, "src2", 1)]
    rows += [(None, "no name here at all", "en", "src3", 1), rows[5], (5, rows[5][1], "en", "src9", None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, documents):
    return spark.createDataFrame(documents, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("k,num,hot,tile", [(4, 85, 64, 1024), (5, 80, 2, 1024), (3, 50, 3, 1024), (3, 50, 2, 4)])
def test_jaccard_components(docs, documents, monkeypatch, k, num, hot, tile):
    monkeypatch.setattr(jaccard, "TILE_ROWS", tile)
    sets = [(d, shingles(t, k)) for d, t, *_ in documents]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= num * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=str)
    got = sorted((tuple(r) for r in jaccard.jaccard_components(docs, k, num, 100, hot_share=0, hot_least=hot).collect()), key=str)
    assert got == want


def test_jaccard_empty_and_clashing_columns(spark, docs, empty):
    assert jaccard.jaccard_components(empty).collect() == []
    odd = docs.selectExpr("doc_id", "text", "'x' as n", "1 as component", "2 as prefix", "'y' as rep", "1 as _gone", "doc_id as component_id")
    kept = jaccard.keep_first(odd)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 1
    assert kept.where("doc_id = 5").count() <= 1


def test_jaccard_of_many_ids_shuffles_no_texts(spark, docs, monkeypatch):
    """Beyond what a broadcast holds, texts are picked by bits of ids where they lie."""
    single = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    parts, kept = (rows(f(frame)) for f, frame in ((jaccard.jaccard_components, single), (jaccard.keep_first, docs)))
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    assert rows(jaccard.jaccard_components(single)) == parts and rows(jaccard.keep_first(docs)) == kept
    ids = jaccard.IdBits(single.where("doc_id % 3 = 0").select("doc_id"), "bits")
    some = jaccard._texts_of(single, ids)
    assert {r.doc_id for r in some.collect()} >= {r.doc_id for r in single.collect() if r.doc_id % 3 == 0} and ids.some(single, "doc_id", inside=False).count() + some.count() == single.count()
    assert "hashpartitioning(text" not in (plan := jaccard._texts_of(docs, ids)._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning" not in plan.split("BroadcastExchange")[0]


def test_jaccard_repeated_rows_and_ids(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta iota kappa " + x for x in ("one", "two three four five six seven", "eight nine"))
    rows = [(1, a), (1, a), (2, b), (2, c + " x y z"), (3, b), (4, c + " x y z"), (None, a), (None, a)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 2, None: None}  # 3 and 4 each equal one text of document 2
    kept = sorted(((r.doc_id, r.text) for r in jaccard.keep_first(frame).collect()), key=str)
    assert kept == sorted([(1, a), (2, b), (2, c + " x y z"), (None, a), (None, a)], key=str)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_contamination(spark, docs, documents, empty):
    rng = np.random.default_rng(1)
    texts = [d[1] for d in documents if d[1]]
    items = [(i, " ".join(texts[i].split()[3:25])) for i in range(12)] + [(20, "one"), (21, "thal onder"), (22, None), (23, ""), (24, prose(rng, 30)), (24, "ÜNÏ"), (25, texts[40])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, t, *_ in documents:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(10, len(v))
            for window in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else ():
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) == window:
                        hit |= set(range(i, i + n))
                        found.add(str(item))
        want.append((d, len(w), len(hit), len(found), tuple(sorted(found))))
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r.item_ids)) for r in decontaminate.contamination(docs, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(x[2] for x in want) and not all(x[2] for x in want)
    old = decontaminate.BROADCAST_BYTES, decontaminate.SALT_ROWS
    decontaminate.BROADCAST_BYTES, decontaminate.SALT_ROWS = -1, 2
    try:
        again = [(r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r.item_ids)) for r in decontaminate.contamination(docs, bench).collect()]
    finally:
        decontaminate.BROADCAST_BYTES, decontaminate.SALT_ROWS = old
    assert sorted(again, key=str) == sorted(want, key=str)
    odd = docs.selectExpr("*", "1 as _id", "2 as _hash", "3 as text_hash", "4 as start")
    assert decontaminate.decontaminate(odd, bench).columns == odd.columns
    assert decontaminate.decontaminate(docs, bench).count() == sum(not x[2] for x in want)
    assert decontaminate.contamination(empty, bench).collect() == []
    assert decontaminate.contamination(docs, bench.where("item_id > 99")).where("n_hit > 0").count() == 0


def test_lines(spark, empty):
    rng = np.random.default_rng(3)
    base = [list(rng.choice(WORDS, 12)) + [f"z{i}"] for i in range(8)]
    rows = []
    for d in range(40):
        out = []
        for _ in range(int(rng.integers(1, 5))):
            line = list(base[int(rng.integers(0, 8))])
            for at in rng.integers(0, 12, int(rng.integers(0, 4))):
                line[at] = str(rng.choice(WORDS))
            out.append("  ".join(line) if d % 2 else " ".join(line).upper())
        rows.append((d, "\n".join(out + [""] * (d % 3))))
    rows += [(50, None), (51, ""), (52, "the"), (53, "THE "), (None, "the of"), (-1, "of the"), (54, "ÄB ab\tÄB  x"), (55, "Äb AB x"), (56, " ".join(f"w{i}" for i in range(20000)))]
    crowd = "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12".split()  # more lines of one kind than are compared at first
    rows += [(100 + i, " ".join([*crowd, f"v{i}"] if i % 3 else [*crowd[:8], f"u{i}", f"y{i}", f"x{i}"])) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key1", urls.F.lit(1))
    norm, first = {}, {}
    for d, t in sorted(rows, key=lambda r: -2 if r[0] is None else r[0]):
        for i, line in enumerate((t if t is not None else "").split("\n") if t is not None else []):
            n = re.sub(r"\s+", " ", line.translate(LOWER)).strip(" ")
            norm[d, i] = n
            if n:
                first.setdefault(n, (d, i))
    seen, late = [], set()
    for n, place in sorted(first.items(), key=lambda x: (-2 if x[1][0] is None else x[1][0], x[1][1])):
        s = set(n.split(" "))
        if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
            late.add(n)
        seen.append(s)
    want = {p: not n or (first[n] == p and n not in late) for p, n in norm.items()}
    got = {(r.doc_id, r.line_no): r.kept for r in lines.judged_lines(frame).collect()}
    assert got == want and not all(want.values())
    assert lines.judged_lines(empty).collect() == []


def test_lines_that_share_only_rare_words_are_cut_before_their_words_are_read(spark, monkeypatch):
    rare, often = [f"r{i}" for i in range(10)], [f"c{i}" for i in range(80)]
    rows = [(1, " ".join(rare + often[:40])), (2, " ".join(rare + often[40:])), (3, " ".join([*rare, *often[:39], "new"])), *((i, " ".join(often)) for i in range(4, 34))]
    seen, plain = [], lines._verified
    monkeypatch.setattr(lines, "_verified", lambda pairs, *a: (seen.extend(pairs.collect()), plain(pairs, *a))[1])
    kept = {r.doc_id for r in lines.judged_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.kept}
    assert kept == {1, 2, 4} and len({(r.id_a, r.id_b) for r in seen}) == 1


def test_lines_of_a_crowd_meet_its_earliest_first(spark, monkeypatch):
    words = [f"q{i}" for i in range(12)]
    rows = [(i, " ".join([*words, f"v{i}"] if i % 3 else [*words[:8], f"u{i}", f"y{i}", f"x{i}"])) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {tuple(r) for r in lines.judged_lines(frame).collect()}
    monkeypatch.setattr(lines, "CROWD", 8)
    assert {tuple(r) for r in lines.judged_lines(frame).collect()} == plain


def test_url_rules_and_model(spark):
    pages = [("http://A.Spam-Farm.example.com/en/7?x", "a.spam-farm.example.com", "/en/7"), ("https://q.net/a#b", "q.net", "/a"), ("https://w.example.net/en/1", "w.example.net", "/en/1"), ("https://w.example.net/en", "w.example.net", "/en"),
             ("http://x.example.com/de/9.html", "x.example.com", "/de/9.html"), ("http://citylibrary.example.org/fr/", "citylibrary.example.org", "/fr/"), ("ftp://xnet/", "xnet", "/"), ("no scheme", "", ""), (None, "", ""), ("a://", "", ""), ("http://net?x/", "net", ""), ("x://y.org/fr/://z.net/", "y.org", "/fr/://z.net/"), ("http://" + "long" * 5000 + ".com/" + "p/" * 5000, "long" * 5000 + ".com", "/" + "p/" * 5000)]
    frame = spark.createDataFrame([(i, p[0]) for i, p in enumerate(pages)], "page_id long, url string").withColumn("rule", urls.F.lit("clash"))
    model = urls.fit(urls.seed_urls(spark))
    got = {r.page_id: r for r in urls.judge(frame, model).collect()}
    rules = ["net/", "example.net/en/", "example.com/de/", "org/fr/"]
    sums = {}
    for i, (_, host, path) in enumerate(pages):
        r = got[i]
        assert (r.host, r.path) == (host, path)
        fits = [x for x in rules if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[x.index("/") :])]
        want = max(fits, key=len, default=None)
        assert r.rule == want
        digits = str.maketrans("123456789", "0" * 9)
        h, p = "^" + host.translate(digits) + "$", path.translate(digits)
        grams = {zlib.crc32((m + s[j : j + n]).encode()) % model.dim for m, s in (("h", h), ("p", p)) for n in (3, 4) for j in range(len(s) - n + 1)}
        margin = model.bias + sum(model.weights[g] for g in grams) / max(1, len(grams)) ** 0.5
        sums[i] = 1 / (1 + np.exp(-margin))
        assert abs(r.probability - sums[i]) < 1e-9
        assert r.verdict == ({"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}[want] if want else "block" if sums[i] > 0.75 else "allow")
    assert got[0].verdict == "block" and got[7].verdict == "allow"
    assert urls.fit(urls.seed_urls(spark).where("label > 5")).bias == 0.0
    assert urls.judge(frame.limit(0), model).collect() == []
    seeds = {r.url: r.label for r in urls.seed_urls(spark).collect()}
    told = urls.judge(urls.seed_urls(spark), model, rules=()).collect()
    assert np.mean([(r.verdict == "block") == (seeds[r.url] == 1) for r in told]) > 0.95


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_tokens_round_trip(spark, docs, documents, empty, plane):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    written = tokens.write_tokens(docs, shared_path(spark, "t"), path, block_ids=1000, segment_ids=5000, plane=plane)
    model, at, want = Tokenizer.from_file(path), 0, []
    for d, text in sorted(((d, t or "") for d, t, *_ in documents), key=lambda r: (-1 if r[0] is None else r[0], r[1])):
        ids = model.encode(text, add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in tokens.token_digest(written).collect()), key=str) == sorted(want, key=str)
    assert tokens.token_digest(tokens.write_tokens(empty, shared_path(spark, "t"), path)).collect() == []


def test_planes_round_trip():
    rng = np.random.default_rng(0)
    for plane in ("byte", "bit"):
        for top in (1, 2, 300, 1 << 16, 1 << 31):
            for n in (0, 1, 7, 8, 4097):
                ids = rng.integers(0, top, n).astype("<u4")
                blocks, sizes = tokens.pack(ids, 1024, plane, 1)
                assert (tokens.unpack(blocks, sizes, n, 1024, plane) == ids).all()


def test_word_encoder_equals_library():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    text = "İstanbul ΣΑΣ Straße don't I'LL éx a\x1cb <|endoftext|>x <|startoftext|> x\u00a0y 12³½ \u00ad ﬁ 中文 🙂 x\ty\r\nz'S 'sé ŉ ǅ ª º e\u0301 \u0301x"
    assert np.frombuffer(tokens.WordEncoder(path, most_words=5).encode([text])[0], "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_language_id(spark, empty):
    rng = np.random.default_rng(2)
    stems = {"aa": "lor mip tas vek nur".split(), "bb": "ché où préf tîn sœr".split(), "cc": "größ über schn pfl ück".split()}
    rows = [(i, " ".join(rng.choice(stems[lang], int(rng.integers(2, 30)))), lang) for i in range(240) for lang in [list(stems)[i % 3]]]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !!", "bb"), (903, "mip lor", None), (None, "lor tas", "aa"), (904, "über " * 40000, "cc")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", urls.F.lit("clash"))
    model = langid.fit(frame.where(~langid.held_out()).drop("score"))
    got = {r.doc_id: r for r in langid.predict(frame, model).collect()}
    told = [(got[i].lang_pred == lang) for i, _, lang in rows[:240] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(told) > 40 and np.mean(told) > 0.97
    for i in (900, 901, 902):
        assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
    assert got[904].lang_pred == "cc" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.fit(empty) is None and {r.lang_pred for r in langid.predict(frame, None).collect()} == {"und"}
    assert langid.predict(empty, model).collect() == []


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        good = i % 4 != 0
        text = prose(rng, int(rng.integers(5, 80)))
        if not good:
            text = [text.upper() + "!!", " | ".join(text.split()), " ".join(["spam"] * 40), text.replace(" ", "### ")][i // 4 % 4]
        rows.append((i, text, ["en", None][i % 2], f"src{i % 3}", int(good)))
    frame = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, g, 0) for i, _, _, _, g in rows[:200]] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(frame, labels).collect()}
    right = [got[r[0]].keep == bool(r[4]) for r in rows[200:]]
    assert np.mean(right) > 0.95
    kept = quality.keep_good(frame.withColumn("score", urls.F.lit(1)), labels)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.keep} and kept.columns == [*frame.columns, "score"]
    assert quality.judge(docs, labels.limit(0)).where("keep and score is null").count() == docs.count()
    assert quality.judge(empty, labels).collect() == []
    assert quality.judge(docs.drop("n_chars"), labels).count() == docs.count()


def test_quality_learns_from_all_sure_texts(spark):
    rng = np.random.default_rng(9)
    made = [prose(rng, 30) for _ in range(700)]
    rows = [(i, t if i % 2 else t.upper() + "!!", "en", f"src{i % 2}") for i, t in enumerate(made)]
    rows += [(1000 + i, "SPAM " * 30, "en", "src0") for i in range(300)]  # copies at an end of the scale
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    model = quality.fit(frame, labels)
    distinct = len({t for _, t, *_ in rows[80:]})
    assert model.rounds[-1] > 1.8 * distinct  # both views are sure of nearly all; copies count once
    assert model.rounds[-1] <= 2 * distinct + 0.01
    again = quality.fit(frame.repartition(7), labels)
    assert (again.content.weights == model.content.weights).all() and (again.page.weights == model.page.weights).all()
    assert np.count_nonzero(model.content.weights) > 0
    held = quality.weighed(frame, 4).groupBy("text").agg(quality.F.sum("weight").alias("w"), quality.F.count_distinct("bag").alias("b")).collect()
    assert all(abs(r.w - 1) < 1e-9 and r.b == 1 for r in held)
    mine = frame.limit(50).selectExpr("text", "lang", "source", "1.0D as weight", "0 as bag")
    x, label, n = quality.lessons(mine, model, 0.9, 1)["content"]
    want = np.zeros((2, (1 << quality.BITS) + 1))
    for r in mine.collect():
        data = np.frombuffer(r.text.encode(), np.uint8)
        at, count = quality.gram_counts(data, quality.SIZES, quality.BITS)
        sure = model.sure(model.page, model.scores(quality.pa.array([r.text]), [r.lang], [r.source])[1], 0.9)[0]
        if sure >= 0:
            want[sure, at] += count / count.sum()
    assert len(label) and all(np.allclose(x[i, :-1] * n[i], want[int(lab), :-1], atol=1e-6) for i, lab in enumerate(label))


def test_raking_meets_the_marginals():
    rng = np.random.default_rng(0)
    cells = rng.integers(50, 500, (4, 3, 2)).astype(float)
    shares = [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4])]
    kept = mixing.rake(cells, shares, 0.2)
    for axis, share in enumerate(shares):
        got = kept.sum(axis=tuple(a for a in range(3) if a != axis))
        assert np.allclose(got / got.sum(), share, atol=1e-6)
    assert abs(kept.sum() - 0.2 * cells.sum()) < 1e-3 and (kept <= cells + 1e-9).all()
    # a cell's factor is a product of one factor an axis
    f = np.log(kept / cells)
    assert np.allclose(f[1:, 1:, 0] - f[:1, 1:, 0] - f[1:, :1, 0] + f[:1, :1, 0], 0, atol=1e-6)
    assert (mixing.rake(np.zeros((2, 2)), [np.array([0.5, 0.5])] * 2, 0.5) == 0).all()


def test_mixing(spark, docs, documents, empty):
    model = mixing.fit_topics(docs)
    targets, described = mixing.targets_of(model), mixing.described(docs, model)
    rows = mixing.mix(described, targets, keep=0.6).collect()
    assert len(rows) == len(documents) and all(0 <= r.probability <= 1 for r in rows)
    want = defaultdict(int)
    for d, t, *_ in documents:
        want[d] = len((t or "").split())
    assert all(r.tokens == want[r.doc_id] for r in rows if r.doc_id != 67)
    # all columns anew in plain Python: classes, raked cells, probabilities, weights and draws
    axes = [[*t, mixing.OTHER] for t in targets.values()]
    place = lambda r: tuple(a.index(v if v in a else mixing.OTHER) for a, v in zip(axes, (r.source, r.lang, r.topic), strict=True))
    tokens = np.zeros([len(a) for a in axes])
    for r in rows:
        tokens[place(r)] += r.tokens
    shares = [mixing.shares_of(t, tokens.sum(axis=tuple(a for a in range(3) if a != i))) for i, t in enumerate(targets.values())]
    least = np.zeros_like(tokens)
    for i in range(3):
        other = tuple(-1 if a == i else slice(None) for a in range(3))
        least[other] = 0.25 * 0.6 * tokens[other]
    kept = mixing.rake(tokens, shares, 0.6, least=least)
    draws = {r.doc_id: r.u for r in docs.selectExpr("doc_id", "pmod(xxhash64(1, doc_id), 1099511627776) / 1099511627776D as u").collect()}
    for r in rows:
        p = kept[place(r)] / tokens[place(r)] if tokens[place(r)] else 0.6
        assert abs(r.probability - p) < 1e-12 and abs(r.weight - p / 0.6) < 1e-12 and r.kept == (draws[r.doc_id] < p)
    again = {(r.doc_id, r.source): r.kept for r in mixing.mix(described, targets, keep=0.6).collect()}
    assert all(again[r.doc_id, r.source] == r.kept for r in rows)
    sampled = mixing.sample_documents(docs, keep=0.6)
    assert sampled.columns == docs.columns
    assert sorted((r.doc_id, r.source) for r in sampled.collect() if r.doc_id is not None) == sorted((r.doc_id, r.source) for r in rows if r.kept and r.doc_id is not None)
    odd = docs.selectExpr("*", "1 as _source", "2 as source_class", "3 as draw", "'t' as topic")
    assert mixing.sample_documents(odd, keep=0.6).columns == odd.columns and mixing.sample_documents(odd, keep=0.6).count() == sampled.count()
    assert mixing.mix(mixing.described(empty, mixing.fit_topics(empty)), targets).collect() == [] and mixing.sample_documents(empty).collect() == []
    assert mixing.mix(described.selectExpr("*", "1 as kept", "2 as _source", "3 as _lang"), targets).count() == len(documents)
    total = spark.range(20000).selectExpr("id as doc_id", "'src' || (id % 3) as source", "'en' as lang", "'short' as topic", "10L as tokens")
    out = mixing.mix(total, {"source": {"src0": 0.6, "src1": 0.3, "src2": 0.1}}, keep=0.4).where("kept").groupBy("source").count().collect()
    share = {r.source: r["count"] / sum(x["count"] for x in out) for r in out}
    assert abs(share["src0"] - 0.6) < 0.03 and abs(share["src2"] - 0.1) < 0.02


def test_topics_are_found_across_languages(spark):
    rng = np.random.default_rng(7)
    themes = [[f"{t}word{i}" for i in range(30)] for t in ("fish", "rock", "tax")]
    small = {"en": "the of and to in".split(), "de": "der die und von zu".split()}
    rows = [(i, " ".join(rng.choice(themes[i % 3], 30)) + " " + " ".join(rng.choice(small[("en", "de")[i % 2]], 30)), ("en", "de")[i % 2], "src0") for i in range(300)]
    frame = spark.createDataFrame(rows + rows[:20], "doc_id long, text string, lang string, source string")
    model = mixing.fit_topics(frame, sample=150, topics=3)
    assert model.sizes.sum() == 150
    got = {r.doc_id: r.topic for r in mixing.described(frame, model).collect()}
    named = [{got[i] for i in range(300) if i % 3 == t} for t in range(3)]
    assert all(len(n) == 1 for n in named) and len(set.union(*named)) == 3
    again = mixing.fit_topics(frame.repartition(5), sample=150, topics=3)
    assert (again.centres == model.centres).all()
    x = mixing.word_rows(mixing.pa.array(["a b a", None, "", "c"]))
    assert x[0].tolist() == [3, 0, 0, 1] and np.allclose(np.sort(x[1][0])[-2:], [np.sqrt(1 / 3), np.sqrt(2 / 3)])


def test_packed_texts_come_in_small_batches(spark, monkeypatch):
    """A row of packed texts is large, so few go to Python at once; counts of any size come back as they are."""
    key, asked, summed = "spark.sql.execution.arrow.maxRecordsPerBatch", [], mixing._summed

    def seen(counts, *args):
        asked.append(int(spark.conf.get(key)))
        return summed(counts, *args)

    monkeypatch.setattr(mixing, "_summed", seen)
    often = (1, 255, 256, 70_000)
    frame = spark.createDataFrame([(i, "w " * n + f"word{i}", "en", "src0") for i, n in enumerate(often)], "doc_id long, text string, lang string, source string").coalesce(1)
    mixing.fit_topics(frame, topics=2)
    assert len(asked) > 1 and all(0 < n <= 16 for n in asked[1:]) and int(spark.conf.get(key)) > 16
    packed = mixing._packed(mixing.word_counts(frame, ["en"]), np.zeros((2, mixing.DIM))).toArrow().to_batches()
    value = [v for batch in packed for *_, v in mixing._texts(batch)]
    assert sorted(np.concatenate(value)) == sorted(np.sqrt(x) / np.sqrt(n + 1) for n in often for x in (1.0, n))


def test_mixing_keeps_values_without_a_target(spark):
    columns = ["id as doc_id", "if(id % 10 = 3, if(id % 20 = 3, null, 'elsewhere'), 'src' || (id % 20)) as source"]
    columns += ["case pmod(hash(id), 7) when 0 then null when 1 then 'it' when 2 then 'de' when 3 then 'fr' when 4 then 'es' else 'en' end as lang"]
    rows = spark.range(8000).selectExpr(*columns, "'some words of prose' as text", "19L as n_chars")
    model = mixing.fit_topics(rows)
    out = mixing.mix(mixing.described(rows, model), mixing.targets_of(model), keep=0.3).collect()
    for other in ([r for r in out if r.lang is None], [r for r in out if r.lang == "it"], [r for r in out if r.source is None], [r for r in out if r.source == "elsewhere"]):
        assert min(r.probability for r in other) > 0.1
        assert abs(np.mean([r.kept for r in other]) - np.mean([r.probability for r in other])) < 0.08
    assert abs(np.mean([r.probability for r in out if r.lang in (None, "it")]) - 0.3) < 0.01  # the share of the corpus
    named = [r for r in out if r.lang not in (None, "it")]
    assert abs(sum(r.probability for r in named if r.lang == "de") / sum(r.probability for r in named) - 0.18) < 0.01
    kept = mixing.sample_documents(rows, keep=0.3).collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in out if r.kept}
    assert mixing.shares_of({"a": 0.6, "b": 0.3}, np.array([1.0, 1.0, 8.0])).round(9).tolist() == [0.6, 0.3, 0.1]


def test_digest_of_items():
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_topics_are_learned_from_every_document(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice([f"{'ab'[i % 2]}{j}" for j in range(20)], 8)), "en") for i in range(2300)]
    frame = spark.createDataFrame([*rows, *rows[:30], (9001, None, "en"), (9002, " ", "en"), (9003, "other words", None)], "doc_id long, text string, lang string")
    model = mixing.fit_topics(frame, topics=2)
    assert model.sizes.sum() == 2301 and sorted(model.sizes) in ([1150, 1151], [1, 2300])  # every text with words, once
    again = mixing.fit_topics(frame.repartition(7), topics=2)
    assert (again.centres == model.centres).all() and (again.sizes == model.sizes).all()
    x = np.concatenate([mixing.word_rows(mixing.pa.array([t for _, t, _ in rows]))[1]])
    y = x - x.mean(axis=0)
    own = (y @ model.centres.T).argmax(axis=1)
    for k in range(2):
        c = (y[own == k] / np.linalg.norm(y[own == k], axis=1)[:, None]).sum(axis=0)
        assert c @ model.centres[k] / np.linalg.norm(c) > 0.999  # a centre is the mean of all its texts


def test_topics_do_not_depend_on_how_texts_are_packed(spark, docs, monkeypatch):
    plain = mixing.fit_topics(docs)
    monkeypatch.setattr(mixing, "PACK", 7)  # fewer than a text has: a row each
    one = mixing.fit_topics(docs)
    assert (one.centres == plain.centres).all() and (one.sizes == plain.sizes).all() and one.sizes.sum() > 1


def test_written_tables_go_once_they_are_used(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr("fieldscope.llm.common.shared_root", lambda spark: f"file://{tmp_path}")
    rows = jaccard.jaccard_components(docs).count()
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert rows == docs.count() and "jaccard-keys" in left
    assert not left & {"jaccard-sets-digest", "jaccard-prefixes", "jaccard-matrix", "jaccard-known", "jaccard-sets", "jaccard-wanted"}
