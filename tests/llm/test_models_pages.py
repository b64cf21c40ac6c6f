import math
import zlib
from collections import Counter

import numpy as np

from sieveline.llm import attention, pages, scoring, toxicity

TOXIC = ["idiot", "moron", "scum", "worthless"]


def toxic_corpus():
    import random

    r = random.Random(11)
    words = ["".join(r.choice("aeiourstlnmdpc") for _ in range(r.randrange(2, 8))) for _ in range(400)] + ["the", "this", "and", "about"]
    docs, labels = [], []
    for i in range(600):
        ws = [r.choice(words) for _ in range(r.randrange(10, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                ws[r.randrange(len(ws))] = r.choice(TOXIC)
        docs.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_reads_through_disguise(spark):
    docs, labels = toxic_corpus()
    odd = [(9000, "what an 1d10t here"), (9001, "a m o r o n came"), (9002, "such sc*um and w0rthl3ss idiooot"), (9003, None), (9004, ""), (None, "this and the about"), (9005, "a a a a a 1 2 3 4"), (9006, "this and that about the " * 2000)]
    d = spark.createDataFrame(docs + odd, "doc_id bigint, text string")
    y = spark.createDataFrame(labels + [(9000, None), (None, 1)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(spark, d, y).collect()}
    assert len(got) == len(docs) + len(odd)
    held = [(got[i]["predicted"], t) for i, t in labels if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert [got[i]["predicted"] for i in (9000, 9001, 9002, 9003, 9004, None, 9005, 9006)] == [1, 1, 1, 0, 0, 0, 0, 0]
    kept = toxicity.without_toxic(spark, d, y)
    assert kept.columns == d.columns and kept.where("doc_id = 9000").count() == 0 and kept.where("doc_id is null").count() == 1
    clashing = d.selectExpr("doc_id", "text", "1 as score", "'x' as predicted", "true as held_out")
    kept = toxicity.without_toxic(spark, clashing, y)
    assert kept.columns == clashing.columns and {(r["score"], r["predicted"]) for r in kept.collect()} == {(1, "x")}
    none = toxicity.score_documents(spark, d.limit(0), y.limit(0))
    assert none.count() == 0
    assert {r["predicted"] for r in toxicity.score_documents(spark, d.limit(3), y.limit(0)).collect()} == {0}


def test_copies_of_a_toxic_text_do_not_teach_its_other_words(spark):
    docs, labels = toxic_corpus()
    copies = [(5000 + i, "the quarzblick was an idiot and a moron") for i in range(200)]
    d = spark.createDataFrame([*docs, *copies, (9001, "this quarzblick is about the " + docs[1][1])], "doc_id bigint, text string")
    y = spark.createDataFrame(labels + [(i, 1) for i, _ in copies], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(spark, d, y).collect()}
    assert got[9001] == 0 and got[5000] == 1


def test_single_doublings_and_pieces_are_read():
    cost = toxicity.model(toxicity.count_grams(["the idiot and the moron told it all to him, stupid as he was"] * 50))
    read = toxicity.Reader(cost)
    for w, plain in (("stuupid", "stupid"), ("idiiot", "idiot"), ("moronn", "moron"), ("stuupiid", "stupid")):
        assert read.restore(w) == plain
    for text, plain in (("an i d iot told", "idiot"), ("the m oron told", "moron"), ("he stupi d was", "stupid"), ("id i ot", "idiot")):
        assert plain + "$" in read.features(text)


def test_viterbi_finds_the_best_path():
    import itertools

    cost = toxicity.model(toxicity.count_grams(["the idiot and the moron told it all to him"] * 50))
    for seg in ("1d10t", "m0r-n", "tt00", "1.7|6-", "6 1 7 |", "117 61"):
        best = None
        for path in itertools.product(*(toxicity.readings(c, i > 0 and c == seg[i - 1], 0 < i < len(seg) - 1) for i, c in enumerate(seg))):
            s, total, text = 0, 0.0, ""
            for out, _, price in path:
                total += price
                if out and not (out == " " and s % toxicity.SIZE == 0):
                    t = s * toxicity.SIZE + toxicity.code(out)
                    total, s, text = total + float(cost[t]), t % toxicity.SIZE**3, text + out
                elif out:
                    text += ""
            total += float(cost[s * toxicity.SIZE])
            best = min(best or (math.inf, ""), (total, text.strip()))
        assert toxicity.viterbi(seg, cost.tolist()) == best[1]


def test_long_words_and_runs_take_time_in_proportion():
    import time

    cost = toxicity.model(toxicity.count_grams(["the idiot and the moron told it all to him"] * 50))
    read = toxicity.Reader(cost, {"idio": 0})
    for text in ("1" * 20_000, "a b c d e f g h " * 20_000, "!" * 50_000 + "x", "@" * 50_000 + "x", "." * 50_000 + "x" + "." * 50_000, "1a" * 20_000, "1." * 20_000 + "x"):
        began = time.process_time()
        read.features(text)
        assert time.process_time() - began < 3


def test_marks_at_the_ends_of_words_go():
    for word, plain in (("(scum).", "scum"), ("!!scum!!", "!!scum"), ("$cum$$$", "$cum"), ("a$$", "a$$"), ("||.x", ".x"), ("@@@", ""), ("", ""), ("!!", "")):
        assert toxicity.core(word) == plain


def test_codes_are_the_same_in_counts_and_lattices():
    assert all(toxicity.codes()[ord(c)] == toxicity.code(c) for c in "a z é ß — “ 😀 語 1 _".split())
    at = toxicity.count_grams(["é—x"])
    assert at[((27 * toxicity.SIZE) + 0) * toxicity.SIZE**2 + 24 * toxicity.SIZE] == 1


N_CLASSES = attention.GROUPS * attention.MEMBERS


def test_gradients():
    r = np.random.default_rng(0)
    p = {k: (v + r.standard_normal(v.shape) * 0.2).astype(float) for k, v in attention.new_parameters(11, np.ones(N_CLASSES) / N_CLASSES).items()}
    x, y, m = r.integers(0, 11, (3, attention.T)), r.integers(0, N_CLASSES, (3, attention.T)), r.random((3, attention.T)) < 0.8
    _, g = attention.loss_and_gradients(p, x, y, m)
    for k in p:
        for _ in range(5):
            at = tuple(r.integers(0, n) for n in p[k].shape)
            losses = []
            for e in (1e-2, -1e-2):
                q = {n: a.copy() for n, a in p.items()}
                q[k][at] += e
                losses.append(attention.loss_and_gradients(q, x, y, m)[0])
            assert abs((losses[0] - losses[1]) / 2e-2 - g[k][at]) < 2e-4


def test_windows_score_each_token_once():
    for n in range(1, 200):
        starts, froms = attention.windows(n)
        seen = [a + i for a, f in zip(starts, froms, strict=True) for i in range(f, attention.T) if a + i < n]
        assert seen == list(range(n))


def plain_score(p, ids, inputs, classes, within):
    """The log probability of ids given the first one, place by place from the definition, in double precision."""
    p, n = {k: v.astype(float) for k, v in p.items()}, len(ids) - 1
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    total = 0.0
    for i in range(n):
        start = 0 if i < attention.T else (i - (attention.T - attention.STEP)) // attention.STEP * attention.STEP
        e = p["E"][inputs[ids[start : i + 1]]]
        q, k, v = np.split(e @ p["A"], 3, axis=1)
        w = softmax(k @ q[-1] * attention.DIM**-0.5 + p["R"][np.arange(len(e))[::-1]])
        h = np.concatenate([e[-1], w @ v, [1]])
        g, m = divmod(classes[ids[i + 1]], attention.MEMBERS)
        total += np.log(softmax(h @ p["G"])[g]) + np.log(softmax(h @ p["M"][g])[m]) + within[ids[i + 1]]
    return total


def test_scores_are_those_of_the_model_s_definition_over_any_number_of_windows():
    r = np.random.default_rng(2)
    p = {k: (v + r.standard_normal(v.shape) * 0.3).astype(np.float32) for k, v in attention.new_parameters(9, np.ones(N_CLASSES) / N_CLASSES).items()}
    inputs, classes, within = r.integers(0, 9, 30), r.integers(0, N_CLASSES, 30), r.standard_normal(30).astype(np.float32)
    some = [r.integers(0, 30, n + 1) for n in (0, 1, 20, 31, 32, 33, 56, 57, 200, 1000)]
    got = attention.score(p, some, inputs, classes, within)
    assert np.allclose(got, [plain_score(p, ids, inputs, classes, within) for ids in some], rtol=1e-4, atol=1e-4)


def test_scores_are_those_of_the_definition(spark, odd_docs, no_docs):
    _, wide, rows = odd_docs
    got = scoring.score_documents(spark, wide, hot=5).collect()
    train = [(t or "").encode().lower().split() for d, t, *_ in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 10]
    c = Counter(w for ws in train for w in ws)
    n, v, ends = sum(c.values()) + len(train), len(c) + 1, len(train)
    lp = lambda k: math.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    want = []
    for d, t, *_ in rows:
        ws = (t or "").encode().lower().split()
        want.append((str(d), len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, n, round(sum(lp(c[w]) for w in ws) + lp(ends), 6)))
    assert sorted((str(g["doc_id"]), g["n_tokens"], g["n_known"], g["train_tokens"], round(g["base_score"], 6)) for g in got) == sorted(want)
    assert all(math.isfinite(g["score"]) and g["score"] < 0 for g in got)
    assert scoring.score_documents(spark, no_docs).count() == 0


def test_words_of_many_texts_are_read_as_each_alone_with_few_calls(monkeypatch):
    import pyarrow as pa
    from collections import Counter
    from sieveline.llm.tokens import ids_of, paths

    r = np.random.default_rng(2)
    texts = [None, "", " \n\t ", "one", "  A b\tA\x0bc\x0cd\re ", "x\xa0y \xa0z w\x85 \u2003 q\u2028 \x1cs t\x1f", "日本 語 É é İ don't 's 12,5 <|endoftext|> \xad", "long" * 400 + " end"]
    texts += [" ".join("".join(r.choice(list("abcdeö'1,"), 6)) for _ in range(40)) for _ in range(50)]
    plain = scoring.Words(paths())
    words = sorted({w for t in texts for w in scoring.lower_words(t)})
    known = {w: 1.0 + i for i, w in enumerate(words[::3])}
    of, calls = scoring.Words(paths()), []
    monkeypatch.setattr(of, "quick", lambda t, special: calls.append(t) or ids_of(paths()).quick(t, special))
    n, hit, sums, rare, ids = scoring.read_words(pa.array(texts), of, (pa.array(list(known), pa.binary()), np.array(list(known.values())), *scoring.flat_ids(pa.array([plain[w][0] for w in known]))))
    for i, t in enumerate(texts):
        ws = scoring.lower_words(t)
        assert (n[i], hit[i], sums[i]) == (len(ws), sum(w in known for w in ws), sum(known.get(w, 0) for w in ws))
        assert {x["word"]: x["k"] for x in rare[i].as_py()} == Counter(w for w in ws if w not in known)
        assert ids[i].as_py() == scoring.stream([plain[w][0] for w in ws]), t
    # one call for all words but the few with other white space inside
    assert len(calls) <= 1 + sum(any(c in w.decode() for c in "\xa0\x85\u2003\u2028\x1c\x1f") for w in words)
    none = scoring.read_words(pa.array([None, ""]), of, (pa.array([], pa.binary()), np.zeros(0), *scoring.flat_ids(pa.array([], pa.binary()))))
    assert none[0].tolist() == [0, 0] and none[4].to_pylist() == [scoring.stream([])] * 2


def test_every_training_document_reaches_the_model(spark, odd_docs):
    from sieveline.llm.tokens import paths

    _, wide, rows = odd_docs
    read = scoring.Words(paths())
    streams = [scoring.stream([read[w][0] for w in scoring.lower_words(t)]) for _, t, *_ in rows]
    docs = spark.createDataFrame(list(enumerate(streams)), "row bigint, ids binary").repartition(3)
    m = scoring.fit(spark, docs, scoring.word_counts(wide), len(rows), paths())
    assert m["seen"] == sum(len(x) // 2 - 1 for x in streams)


def test_states_are_averaged_over_any_number_of_partitions(spark, monkeypatch):
    monkeypatch.setattr(scoring, "FAN", 3)
    rows = [(i, i + 1, np.array([i, 2.0 * i], "<f4").tobytes()) for i in range(11)]
    p, seen = scoring.average(spark, scoring.written(spark, spark.createDataFrame(rows, "part bigint, seen bigint, E binary"), "t"), {"E": np.zeros(2)})
    assert seen == 66 and np.allclose(p["E"], np.array([1, 2]) * sum(i * (i + 1) for i in range(11)) / 66)
    p, seen = scoring.average(spark, scoring.written(spark, spark.createDataFrame([], "part bigint, seen bigint, E binary"), "t"), {"E": np.ones(2)})
    assert seen == 0 and p["E"].tolist() == [1, 1]


def test_the_model_beats_a_smoothed_unigram_on_held_out_documents(spark):
    """The unigram holds out probability for words it never saw, as the model does: over subwords, each with 0.1 added."""
    from sieveline.llm.tokens import paths

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in scoring.score_documents(spark, docs).select("doc_id", "held_out", "score").collect()}
    read, counts = scoring.Words(paths()), np.full(scoring.SIZE, 0.1)
    texts = {r["doc_id"]: np.frombuffer(scoring.stream([read[w][0] for w in scoring.lower_words(r["text"])]), "<u2")[1:] for r in docs.select("doc_id", "text").collect()}
    for d, ids in texts.items():
        if not got[d]["held_out"]:
            counts += np.bincount(ids, minlength=scoring.SIZE)
    logs = np.log10(counts / counts.sum())
    held = [d for d in texts if got[d]["held_out"]]
    model, unigram = sum(got[d]["score"] for d in held), sum(logs[texts[d]].sum() for d in held)
    assert model > 0.95 * unigram


def test_attention_learns():
    r = np.random.default_rng(1)
    streams = [np.array([0, *([1, 2, 3, 4] * 20), 0]) for _ in range(60)]
    inputs, classes, within = np.arange(5), np.arange(5) * 9, np.zeros(5, np.float32)
    p0 = attention.new_parameters(5, np.bincount(classes, minlength=N_CLASSES) / 5)
    t = attention.Trainer(p0)
    for _ in range(30):
        t.learn(streams, inputs, classes)
    assert t.seen == 30 * 60 * 81
    before, after = (attention.score(p, streams[:1], inputs, classes, within)[0] for p in (p0, t.p))
    shuffled = attention.score(t.p, [np.array([0, *r.permutation([1, 2, 3, 4] * 20), 0])], inputs, classes, within)[0]
    assert after > before / 3 and after > shuffled


PAGE = """<html><head><title>t</title><script>var a="</p>";</script></head><body><header><p>Top, of, site</p></header><nav><ul><li><a href=/a>menu</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, as all, do.</p></div><article><h1>Title &amp; more</h1><p><b>First  block,
with text.<br><p>Second&nbsp;block, caf&eacute;.</p><form><p>form text</p></form><ul><li>item one<li>item two</ul></article>
<div class="sidebar"><p>side, side, side</p></div><div id="comments"><p>reader, comments, are not, the text</p></div><footer>foot</footer>"""


def test_main_text():
    assert pages.main_text(PAGE) == "Title & more\nFirst block, with text.\nSecond block, café.\nitem one\nitem two"
    assert pages.main_text(PAGE.replace("article>", 'div>').replace("<div><h1>", '<div class="content"><h1>')) == "Title & more\nFirst block, with text.\nSecond block, café.\nitem one\nitem two"
    assert pages.main_text(None) == pages.main_text("") == pages.main_text("<nav>only</nav>") == ""
    assert pages.main_text("<p>short") == "short" and pages.main_text("a < b") == "a < b"


def test_layout_and_post_classes_do_not_cut_the_text():
    text = "One long sentence, of the text, that goes on. " * 5
    for name in ("content with-sidebar", "entry-content no-sidebar", "post-12 post type-post tag-news"):
        page = f'<body><div class="{name}"><p>{text}</p><p>{text}</p><div class="share-post"><p>Share, it, now.</p></div></div><div class="sidebar"><p>side, side</p></div>'
        assert pages.main_text(page) == "\n".join([text.strip()] * 2)
    assert pages.main_text(f'<body><div class="has sidebar"><article><p>{text}</p></article></div>') == text.strip()
    comments = f'<div id="comments"><article class="comment-body"><p>Reader, says.</p></article></div>'
    assert pages.main_text(f"<body><article><p>{text}</p></article>{comments}") == text.strip()


def test_long_pages_take_time_in_proportion():
    import time

    n = 20_000
    for page in ("<div>" * n + "</p>" * n, "<b>" * n + "<p>x" * n, "<noscript>" * 2 * n, "<td>" + "<p><span>" * n + "</i>" * n, "<a" * n, "<!x" * n, "</1" * n, "<div><p>a, b" * n, '<a "' * n, "<li><ul>" * n + "</li>" * n, "<!--" * n, "&amp" * n):
        began = time.process_time()
        pages.main_text(page)
        assert time.process_time() - began < 2


def test_the_scored_container_wins():
    long = "A long sentence, of the story, that has commas, and goes on and on. " * 4
    story = f'<div class="wrap"><div id="x"><h1>Head</h1><p>{long}</p><p>{long}</p><p>Short end.</p></div><div id="y"><p><a href=/>{long}</a></p></div></div>'
    want = "\n".join(["Head", long.strip(), long.strip(), "Short end."])
    assert pages.main_text(f"<body><article class=teaser><p>Read, this, too.</p></article>{story}") == want
    assert pages.main_text(f"<body><form action=/>{story}<input><button>Go</button></form>") == want
    assert pages.main_text(f"<body>{story}<form><p>Name, please, here.</p></form>") == want
    # ties: the first in the page
    assert pages.main_text(f"<body><div><section><p>{long}1</p></section></div><div><section><p>{long}2</p></section></div>").endswith("1")


def test_pages_query(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "<p>" + "long text, " * 50_000, "y"), (3, "w", "<div>" * 3000 + "deep" + "<a " * 3000, "z")], "page_id bigint, url string, html string, text string")
    got = pages.extract_pages(df).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert pages.extract_pages(df.limit(0)).count() == 0


def test_shared_article_text_on_the_given_pages(spark):
    import html as entities
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>|<br>", inner)]
        assert pages.main_text(r["html"]) == "\n".join(x for x in want if x)
