"""Operators against plain Python, exact round trips and held-out accuracy on small fixtures."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.llm import common, decontaminate, html, language, licenses, media, packing, pii, quality, rounds, simhash, toxicity
from cloudloom.operators.graph import connected_components, stored

WORDS = "river stone light under green paper window seven mountain quick silver garden".split()


def texts(n: int, seed: int = 0, least: int = 3, most: int = 60) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randint(least, most))) for _ in range(n)]


# --- packing ---------------------------------------------------------------


def test_cut_puts_the_short_piece_first():
    assert packing.cut(10, 4) == [(0, 2), (2, 4), (6, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(1, 4) == [(0, 1)]


def test_both_tokenizers_agree():
    both = packing.tokenizer()
    for t in [*texts(40), "Ünïcode naïve — 漢字 😀\n\n  tabs\t", "it's 12,345.67%", "a" * 5000, "<|endoftext|> x"]:
        assert both(t) == both.full.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_each_piece_once_and_fits(seed):
    rng = np.random.default_rng(seed)
    hist = np.zeros(65, np.int64)
    for v in rng.integers(1, 65, 3000):
        hist[v] += 1
    plan = packing.plan_packing(hist, 64)
    used = np.zeros_like(hist)
    for shape, rep in plan:
        assert rep > 0 and sum(shape) <= 64
        for v in shape:
            used[v] += rep
    assert (used == hist).all()
    total = sum(r for _, r in plan)
    bound = max(-(-int((hist * np.arange(65)).sum()) // 64), int(hist[33:].sum()))
    assert total <= bound * 1.02 + 2
    patterns = packing.enumerate_patterns(np.flatnonzero(hist), 64)
    assert (packing.fit_repeats(patterns, hist) >= 0).all()


def test_packed_sequences_hold_the_documents(spark, frame):
    docs = [(i, t) for i, t in enumerate(texts(60, 1, 1, 90))] + [(99, None)]
    packed = packing.pack_documents(frame(docs), max_tokens=64, with_ids=True)
    rows = packed.collect()
    encode = packing.tokenizer()
    for doc_id, t in docs:
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
        ids = [x for r in own for x in r.ids]
        assert ids == [*encode(t or ""), 2] and [r.start for r in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert sum(map(len, whole.values())) == sum(r.length for r in rows)


# --- html ------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="ad">Buy, now, cheap, things, of every kind that anybody could ever want to have.</div><article><h1>Title &amp; more</h1><p>First, long paragraph, with commas, and <b>bold</b>text.<br>Next line
<p>Second.</p><aside>Side, bar, text, that is quite long, really, but not part of it.</aside><div class="comments"><p>Nice article, I liked it, a lot, really.</p></div></article>
<form>Mail <input></form><footer>&copy; foot</footer><script>var t="</p>";</script></body></html>"""


def test_main_text_of_a_page():
    assert html.main_text(PAGE)[0] == "Title & more First, long paragraph, with commas, and boldtext. Next line Second."


@pytest.mark.parametrize(
    "part", ["<header><h1>inner title</h1></header>", "<p>let <math><mi>inner</mi></math> be</p>", '<section class="related-work"><p>inner work</p></section>', "<p>one of <select><option>inner</select></p>", '<div id="share-of-voice"><p>inner share</p></div>']
)
def test_parts_of_the_article_stay(part):
    page = f"<html><head><title>T</title></head><body><header>Site</header><article><p>{'Some long text, with commas, and more. ' * 4}</p>{part}<div class='share-buttons social'>Tweet</div><div class='related-links'>See also</div></article><footer>f</footer></body></html>"
    text = html.main_text(page)[0]
    assert "inner" in text and not any(x in text for x in ("Site", "Tweet", "See also")) and text.startswith("Some long")


def test_container_without_semantic_tags():
    page = "<div id=a><a href=1>one</a><a href=2>two</a></div><div id=b><p>" + "Real text, with commas, and words. " * 5 + "</p><p>" + "More text, with commas, too. " * 5 + "</p></div><div id=c><a href=3>See also, these, many, links, here</a></div>"
    text = html.main_text(page)[0]
    assert text.startswith("Real text") and text.endswith("too.") and "See also" not in text and "one" not in text


@pytest.mark.parametrize("page", ["<", "<p", "</p>", "a<b>c", "<p><b>x<p>y</b>z", "<script>never closed", "<!-- open", "<ul><li>a<li>b</ul>", "&#128512;&bogus;"])
def test_broken_markup_never_fails(page):
    assert isinstance(html.main_text(page)[0], str)


# --- classifiers -----------------------------------------------------------


def _labelled(spark, n: int, bad) -> tuple:
    rng = random.Random(4)
    rows = []
    for i, t in enumerate(texts(n, 5, 20, 60)):
        y = int(rng.random() < 0.4)
        rows.append((i, bad(t, rng) if y else t, y))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - y, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def test_quality_on_rows_that_were_not_learned(spark):
    docs, labels, truth = _labelled(spark, 400, lambda t, rng: " ".join(w + rng.choice(["!!", "$$$", "%%%"]) for w in t.upper().split()))
    vectors = spark.sparkContext.broadcast(quality.word_vectors(docs))
    net = quality.train(docs, labels.where(~common.fold("doc_id", 5, 0)), vectors)
    scored = quality.score_quality(docs, net, vectors).withColumn("held", common.fold("doc_id", 5, 0)).where("held").collect()
    assert np.mean([(r.score >= 0.3) == (truth[r.doc_id] == 0) for r in scored]) >= 0.95


def test_toxicity_on_rows_that_were_not_learned(spark):
    def spoil(t, rng):
        words = t.split()
        for _ in range(3):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "scum"]))
        return " ".join(words)

    docs, labels, truth = _labelled(spark, 400, spoil)
    net = toxicity.learn(docs, labels.where(~common.fold("doc_id", 3, 1)))
    scored = toxicity.score_toxicity(docs, net).withColumn("held", common.fold("doc_id", 3, 1)).where("held").collect()
    assert np.mean([(r.score >= 0.7) == bool(truth[r.doc_id]) for r in scored]) >= 0.95
    clean = {r.doc_id for r in toxicity.keep_clean(docs, net).collect()}
    assert clean == {r.doc_id for r in toxicity.score_toxicity(docs, net).where("score < 0.7").collect()}


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 1500)
    rng = random.Random(14)
    some = lambda: [rng.choice(WORDS) for _ in range(rng.randrange(8, 14))]
    order = [r[0] for r in spark.range(3100).orderBy(F.xxhash64("id", F.lit(7))).collect()]
    late = set(order[2500:])  # beyond a sample of 2,500 of a class
    docs = [(k, " ".join([*some(), "zorblax" if k in late else "idiot", *some()])) for k in range(3100)]
    docs += [(k, " ".join(some() + some())) for k in range(4000, 5500)]
    new = [(10_000 + k, " ".join([*some(), *(["zorblax"] if k % 2 else []), *some()])) for k in range(60)]
    labels = spark.createDataFrame([(i, int(i < 4000)) for i, _ in docs], "doc_id long, toxic int")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    nets = [toxicity.learn(frame(docs).repartition(n), labels) for n in (2, 5)]
    assert np.array_equal(nets[0].table, nets[1].table) and nets[0].thresholds == nets[1].thresholds
    found = {r.doc_id: r.score >= 0.7 for r in toxicity.score_toxicity(frame(new), nets[0]).collect()}
    assert sum(found[i] == bool(i % 2) for i, _ in new) >= 57


def test_texts_to_learn_from_are_shuffled_once(spark, monkeypatch):
    plans, encoded = [], toxicity._encoded
    monkeypatch.setattr(toxicity, "_encoded", lambda rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or encoded(rows))
    monkeypatch.setattr(toxicity, "SHARD", 20)
    docs, labels, _ = _labelled(spark, 60, lambda t, rng: t + " idiot")
    toxicity.learn(docs, labels)
    assert sum("Exchange hashpartitioning" in line and "doc_id" in line for line in plans[0].splitlines()) == 1


def test_sums_take_one_vector_to_the_driver(spark, monkeypatch):
    sent = []
    frame = spark.range(1000).repartition(9)
    collect = type(frame).collect
    monkeypatch.setattr(type(frame), "collect", lambda self: sent.append(collect(self)) or sent[-1])
    for width in (1, 63, 64, 1000):
        tally = lambda batches, width=width: sum((np.bincount(b.column(0).to_numpy() % width, minlength=width) for b in batches), np.zeros(width, np.int64))
        assert common.sum_vectors(frame, tally, width, "i8").tolist() == np.bincount(np.arange(1000) % width, minlength=width).tolist()
        assert sorted(r.piece for r in sent.pop()) == list(range(-(-width // -(-width // common.PIECES))))


def test_long_texts_score_alike_in_stretches():
    net = toxicity.Convolution()
    net.ready = True
    scorer = toxicity.Scorer(net)
    words = ("alpha beta gamma delta " * 60_000).split()
    ids = np.concatenate((scorer._ids(words), np.zeros(3, np.int64)))
    whole = net.raw(scorer.vectors[ids], np.zeros(1, np.int64))[0]
    assert abs(scorer._long(ids) - whole) < 1e-6


def test_toxicity_of_a_text_does_not_depend_on_its_neighbours():
    net = toxicity.Convolution()
    net.ready = True
    some = [*texts(120, seed=31), "", "word", *texts(3, seed=32, least=5000, most=5200)]
    alone = [toxicity.Scorer(net).score([t])[0] for t in some]
    assert np.abs(np.array(toxicity.Scorer(net).score(some)) - alone).max() < 1e-6  # filters saw the next text's first words
    assert np.abs(np.array(toxicity.Scorer(net).score(some[::-1])) - alone[::-1]).max() < 1e-6


def test_toxicity_words_and_parts():
    latin = "".join(map(chr, range(256)))
    for t in (latin, latin[::-1], "a".join(latin), "", "It's 3 o'clock_now", "Müßig, ÉTÉ!", "“quoted” – œuvre", "Ὀδυσσεύς ΑΣ İstanbul", "\ud800x y"):
        assert toxicity.words_of(t) == toxicity.WORD.findall(t.lower())
        for w in toxicity.words_of(t):
            assert toxicity.parts(w) == tuple(zlib.crc32(f"{k}{x}".encode("utf-8", "surrogatepass")) % toxicity.CELLS for k, x in enumerate((w, w[:3], w[:4], w[:5])))


# --- language --------------------------------------------------------------

PROSE = {"en": "the people of the house went to the river and saw that it was good for them", "de": "die leute aus dem haus gingen zu dem fluss und sahen dass es gut für sie war", "fr": "les gens de la maison sont allés à la rivière et ont vu que cela était bon"}


def _model(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.sample(t.split(), 12)), lang) for i in range(40) for lang, t in PROSE.items()]
    return language.learn(spark.createDataFrame([*rows, (0, "привет добрый день мир", "ru")], "doc_id long, text string, lang string"))


def test_language_and_spans(spark, frame):
    model = _model(spark)
    found = {r.doc_id: r for r in language.identify(frame([(1, PROSE["en"]), (2, PROSE["de"]), (3, PROSE["fr"] + " " + PROSE["en"] + " " + PROSE["fr"]), (4, "мир добрый"), (5, "漢字")]), model).collect()}
    assert [found[k].lang_pred for k in range(1, 6)] == ["en", "de", "fr", "ru", "und"]
    assert set(found[3].letters) >= {"fr", "en"} and 0 < found[3].score < 1


def test_every_language_is_learned(spark, frame):
    rng = random.Random(7)
    own = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for k in range(300)}
    rows = [(0, " ".join(rng.sample(w, 12)), lang) for lang, w in own.items() for _ in range(1 if lang == "l150" else 2)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=2)
    assert model.langs == sorted(own)
    found = {r.doc_id: r.lang_pred for r in language.identify(frame([(k, " ".join(own[f"l{k:03d}"])) for k in (0, 70, 150, 299)]), model).collect()}
    assert found == {k: f"l{k:03d}" for k in (0, 70, 150, 299)}


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    from itertools import product

    scores = rng.normal(0, 2, (7, 3)).astype(np.float32)
    best = max(product(range(3), repeat=7), key=lambda p: sum(scores[k, s] for k, s in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:], strict=False)))
    assert language.viterbi(scores, np.array([7]), 1.5).tolist() == list(best)
    long = rng.normal(0, 1, (20_000, 3)).astype(np.float32)  # the path through a long text is one path
    state, back = np.zeros(3), []
    for s in long.astype(float):
        back.append([int(np.argmax(state - 2.0 * (np.arange(3) != k))) for k in range(3)])
        state = np.array([state[b] - 2.0 * (b != k) for k, b in enumerate(back[-1])]) + s
    path = [int(state.argmax())]
    for b in reversed(back[1:]):
        path.append(b[path[-1]])
    assert np.mean(language.viterbi(long, np.array([20_000]), 2.0) == path[::-1]) > 0.999  # float32 sums may tie
    both = language.viterbi(np.concatenate((scores[:3], scores)), np.array([3, 7]), 1.5)
    assert both[3:].tolist() == list(best)


# --- decontamination -------------------------------------------------------


def _windows(items, n):
    out = {}
    for i, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
        k = min(n, len(w))
        for p in range(len(w) - k + 1) if k else []:
            out.setdefault(tuple(w[p : p + k]), set()).add(i)
    return out


@pytest.mark.parametrize("limit", [decontaminate.SET_LIMIT, 0])
def test_contamination_against_plain_python(spark, frame, limit):
    items = [(1, "One two THREE four five six."), (2, "river stone light"), (3, "one two three four five six seven"), (4, None), (5, "x"), (6, "?!")]
    docs = [(1, "zero one two, three four five six seven!"), (2, "river-stone  LIGHT river stone light"), (3, "nothing here"), (4, None), (5, "X"), (6, "y " * 50 + "one two three four")]
    rows = {r.doc_id: r for r in decontaminate.contamination(frame(docs), spark.createDataFrame(items, "item_id long, text string"), width=4, set_limit=limit).collect()}
    wins = _windows(items, 4)
    for i, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
        hit, ids = set(), set()
        for p in range(len(w)):
            for k in range(1, 5):
                if tuple(w[p : p + k]) in wins and p + k <= len(w):
                    hit |= set(range(p, p + k))
                    ids |= wins[tuple(w[p : p + k])]
        assert (rows[i].n_words, rows[i].n_hit, rows[i].items) == (len(w), len(hit), sorted(map(str, ids))), i


def test_removal_leaves_clean_text_alone(spark, frame):
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    docs = [(1, "Start: One, two THREE four; and the end of this longer text."), (2, "clean,  text\tstays   as it is"), (3, "one two three four"), (4, None)]
    out = {r.doc_id: r.text for r in decontaminate.remove_contaminated(frame(docs), bench, width=4).collect()}
    assert out[2] == docs[1][1] and out[4] is None and 3 not in out
    assert "two" not in out[1].lower() and out[1].startswith("Start: ") and out[1].endswith("and the end of this longer text.")


# --- near-duplicates -------------------------------------------------------


def _plain_fingerprint(t):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
    sh = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_against_plain_python():
    for t in [*texts(20), None, "", "one", "One TWO", "a b c", "Ä ö Ü   x", "a\x0bb\x1cc d"]:
        assert simhash.fingerprint(t) == _plain_fingerprint(t)


@pytest.mark.parametrize(("crowd", "block"), [(64, 20_000), (1, 7)])
def test_links_find_every_component(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 12)
    fps = set()
    for b in base:  # tight groups, chains and strays
        x = int(b)
        for _ in range(30):
            fps.add(x)
            for bit in rng.integers(0, 63, rng.integers(1, 6)):
                x ^= 1 << int(bit)
    fps = sorted(fps)
    reps = common.checkpoint(spark.createDataFrame([(f,) for f in fps], "fp long"))
    from cloudloom.operators.graph import connected_components

    found = {r.node: r.component for r in connected_components(simhash.links(reps)).collect()}
    root = {f: f for f in fps}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    assert {f: found.get(f, f) for f in fps} == {f: find(f) for f in fps}


def test_thresholds_keep_the_pigeonhole():
    rng = np.random.default_rng(1)
    bits = rng.random((500, 64)) < rng.uniform(0.2, 0.8, 64)
    both = bits.T.astype(float) @ bits
    for n in (500.0, 1e6, 1e9):
        plan = simhash.choose_partitions(n, both * n / 500, 3)
        assert sum(t + 1 for _, t in plan) == 4
        seen = [b for g, _ in plan for b in g]
        assert len(seen) == len(set(seen))


def test_keep_one_verifies_similarity(spark, frame):
    rng = random.Random(2)
    base = texts(30, 21, 60, 90)
    docs = [(i, t) for i, t in enumerate(base)]
    for k in range(12):  # one or two words changed: over 0.8 in five-word shingles
        words = base[k].split()
        for at in rng.sample(range(10, 50), 1 + k % 2):
            words[at] = "changed"
        docs.append((100 + k, " ".join(words)))
    docs += [(200, base[0]), (201, base[0].upper())]
    kept = {r.doc_id for r in simhash.keep_one(frame(docs)).collect()}
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs}
    same = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert set(range(30)) <= kept and not kept & {200, 201}
    gone = {100 + k for k in range(12)} - kept
    assert all(same(i, i - 100) for i in gone) and len(gone) >= 0.7 * sum(same(100 + k, k) for k in range(12))


@pytest.mark.parametrize("crowd", [64, 1])
def test_keep_one_finds_pairs_near_the_threshold(spark, frame, monkeypatch, crowd):
    monkeypatch.setattr(rounds, "CROWD", crowd)
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    docs = []
    for k in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([55, 80, 110, 250]))]
        other = list(words)
        for at in rng.sample(range(5, len(words) - 5), max(1, len(words) // 60)):
            other[at] = "changed"
        docs += [(k, " ".join(words)), (1000 + k, " ".join(other))]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs}
    whole = [k for k in range(150) if len(sets[k] & sets[1000 + k]) >= 0.8 * len(sets[k] | sets[1000 + k])]
    kept = {r.doc_id for r in simhash.keep_one(frame(docs)).collect()}
    gone = {i for i, _ in docs} - kept
    assert len(whole) > 100 and gone <= {1000 + k for k in whole} and len(gone) >= 0.9 * len(whole)


@pytest.mark.parametrize("crowd", [64, 1])
def test_keep_one_leaves_out_no_similar_pair(spark, frame, monkeypatch, crowd):
    monkeypatch.setattr(rounds, "CROWD", crowd)
    rng = random.Random(6)
    docs = []
    for k in range(100):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([52, 60, 100, 300]))]
        other = list(words)
        for at in rng.sample(range(len(words)), max(1, len(words) // 52)):
            other[at] = f"new{k}"
        docs += [(k, " ".join(words)), (1000 + k, " ".join(other))]
        if k % 4 == 0:  # a word at length: two shingles or so, but most of the text's words
            docs.append((2000 + k, " ".join(words + [f"long{k}"] * 400)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in (i % 1000 + 1000, i % 1000 + 2000):  # other families share no words in order
            if j > i and j in sets and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                p, q = sorted((root[i], root[j]))
                root = {k: p if r == q else r for k, r in root.items()}
    kept = {r.doc_id for r in simhash.keep_one(frame(docs)).collect()}
    assert kept == set(root.values()) and len(kept) < 140


@pytest.mark.parametrize("crowd", [64, 1])
def test_keep_one_follows_links_that_miss_the_hub(spark, frame, monkeypatch, crowd):
    monkeypatch.setattr(rounds, "CROWD", crowd)
    rng = random.Random(5)
    docs = []
    for g in range(3):  # 80 texts that share keys, each a chain of changes away from the last
        words = [f"g{g}w{k}" for k in range(200)]
        for k in range(80):
            docs.append((g * 100 + k, " ".join(words)))
            for at in rng.sample(range(200), 4):
                words[at] = f"n{g}x{k}y{at}"
    rng.shuffle(docs)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in docs}
    root = {i: i for i in sets}
    weights = simhash.word_weights(frame(docs))
    fps = {r._row: r.fp for r in simhash.described(spark.createDataFrame([(i, i, t) for i, t in docs], "_row long, doc_id long, text string"), weights, 5).collect()}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= simhash.MAX_BITS:
                p, q = sorted((root[i], root[j]))
                root = {k: p if r == q else r for k, r in root.items()}
    kept = {r.doc_id for r in simhash.keep_one(frame(docs)).collect()}
    assert kept == set(root.values()) and len(kept) < 60


def test_similar_sets_share_one_of_their_first_shingles():
    rng = np.random.default_rng(12)
    counts = rng.integers(0, 9, simhash.SHINGLE_CELLS).astype(np.int32)
    for n in (1, 2, 5, 15, 40, 333):
        for changed in range(n // 5 + 1):
            a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
            b = np.unique(np.concatenate((a[rng.permutation(n)[changed:]], rng.integers(-(1 << 62), 1 << 62, changed // 2))))
            p, q = (simhash.prefix(x, counts, 0.8) for x in (a, b))
            assert len(p) <= 0.2 * n + 1
            if simhash.jaccard_at_least(0.8)(a, b):
                assert len(np.intersect1d(p, q))
    assert len(simhash.prefix(a[:0], counts, 0.8)) == 0


def test_index_rows_of_a_text_do_not_depend_on_the_others(spark, frame, monkeypatch):
    rows = []
    monkeypatch.setattr(simhash, "meeting", lambda index: rows.append(index.count()) or rounds.meeting(index))
    docs = [(i, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(4000)]
    for n in (40, 4000):  # fingerprints in partitions took more probes of each text the more there were
        assert simhash.keep_one(frame(docs[:n])).count() == n
    assert rows == [40 * 8, 4000 * 8]  # of 36 shingles 29 must be shared, so 8 are kept


def test_a_pair_of_a_family_is_met_once(spark, monkeypatch):
    met = []

    def seen(index, close, load, same):
        p, q = (index.select("key", *[F.col(c).alias(f"{c}_{s}") for c in index.columns if c != "key"]) for s in "ab")
        near = close(lambda c: F.col(f"{c}_a"), lambda c: F.col(f"{c}_b"))
        met.extend(p.join(q, "key").where("node_a < node_b").select("node_a", "node_b", near.alias("near")).collect())
        return spark.createDataFrame([], "a long, b long")

    monkeypatch.setattr(simhash, "link_rounds", seen)
    rng = random.Random(23)
    texts = []
    for k in range(40):  # alike texts that share most of their first shingles, none all
        words = [f"w{i}" for i in range(400)]
        for at in rng.sample(range(400), 3):
            words[at] = f"x{k}y{at}"
        texts.append((k, k, " ".join(words)))
    rows = spark.createDataFrame(texts, "_row long, doc_id long, text string")
    known = simhash.described(rows, simhash.word_weights(rows), 5, np.zeros(simhash.SHINGLE_CELLS, np.int32))
    simhash.similar_links(known.withColumnRenamed("_row", "node"), rows, 5, 0.8, 64)
    pairs = {(r.node_a, r.node_b) for r in met}
    near = [(r.node_a, r.node_b) for r in met if r.near]
    assert len(pairs) == 780 and set(near) == pairs and len(near) < 1.1 * len(pairs) < 0.05 * len(met)


def test_copies_in_keys_of_few_nodes_cost_their_number(spark, monkeypatch):
    tried, delivered = [], rounds.delivered
    monkeypatch.setattr(rounds, "delivered", lambda pairs, *more: tried.append(pairs.count()) or delivered(pairs, *more))
    rows = [(key, node, False) for node in range(60) for key in range(node // 30 * 5, node // 30 * 5 + 5)]
    index = stored(spark.createDataFrame(rows, "key long, node long, probe boolean"))
    load = lambda names: names.select("node", F.array(F.floor(F.col("node") / 30)).alias("payload"))
    links = rounds.link_rounds(index, lambda p, q: F.lit(True), load, lambda x, y: bool(x[0] == y[0]))
    comps = {r.node: r.component for r in connected_components(links).collect()}
    assert comps == {k: k // 30 * 30 for k in range(60)} and sum(tried) < 120  # 870 pairs share a key


# --- licenses --------------------------------------------------------------


def test_rounds_do_not_add_up_partitions(spark, monkeypatch):
    """Stars, pairs and hubs each leave links; their tables get no more partitions with every round."""
    monkeypatch.setattr(rounds, "START", 1)
    rows = [(key, node, False) for key, nodes in ((1, range(0, 40)), (2, range(30, 42)), (3, range(50, 60))) for node in nodes]
    payload = spark.createDataFrame([(n, [n % 3]) for n in range(60)], "node long, payload array<long>")
    index = common.checkpoint(spark.createDataFrame(rows, "key long, node long, probe boolean").repartition(4))
    handed, delivered = [], rounds.delivered
    monkeypatch.setattr(rounds, "delivered", lambda pairs, *more: handed.append(pairs.rdd.getNumPartitions()) or delivered(pairs, *more))
    load = lambda names: payload.join(names, "node", "left_semi")
    found = []
    for part_rows in (50_000, 5):
        monkeypatch.setattr(rounds, "PART_ROWS", part_rows, raising=False)
        links = rounds.link_rounds(index, lambda p, q: F.lit(True), load, lambda x, y: bool(x[0] == y[0]), crowd=4)
        if part_rows > 5:
            assert links.rdd.getNumPartitions() == 1 and len(handed) > 2 and set(handed) == {1}
        found.append({tuple(r) for r in connected_components(links).collect()})
    truth = {(n, n % 3) for n in range(42)} | {(n, 50 + (n - 50) % 3) for n in range(50, 60)}
    assert found[0] == found[1] == truth


def test_license_rules(spark, frame):
    assert len(licenses.rules()) > 200 and len({r[0] for r in licenses.rules()}) == len(licenses.rules())
    docs = [(1, "Released under the MIT License, and so on."), (2, "Apache License, Version 2.0 (the License)"), (3, "licensed under CC BY-NC-SA 4.0"), (4, "no such thing"), (5, "GNU General Public License, version 3; under the mit license under the mit license")]
    rows = {r.doc_id: r for r in licenses.scan_licenses(frame(docs)).collect()}
    labels = {k: {d.label for d in r.detections} for k, r in rows.items()}
    assert rows[1].base_labels == ["mit"] and labels[1] == {"mit"} and rows[1].first_word == 1
    assert rows[2].base_labels == ["apache-2"] and labels[2] == {"apache-2"}
    assert labels[3] == {"cc-by-nc-sa"} and rows[3].base_labels == ["cc-by-nc"]
    assert labels[4] == set() and rows[5].n_base == 2 and labels[5] == {"gpl-3", "mit"} and rows[5].last_word > rows[5].first_word


# --- personal data ---------------------------------------------------------

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def test_spans_against_the_patterns():
    rng = random.Random(6)
    pieces = ["a.b@c.de", "x@y", "@@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 010-9999", "+123", "+49 30 1234567890123456", "-", ".", " ", "é", "\n", "@", "9", "00"]
    for _ in range(300):
        t = "".join(rng.choice(pieces) for _ in range(12))
        want = []
        for k, rx in enumerate(PATTERNS):
            for m in re.finditer(rx, t):
                d = re.sub("[^0-9]", "", m[0])
                if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 12 <= len(d) <= 19 and pii.luhn(d) or k == 3 and 9 <= len(d) <= 15:
                    want.append((m.start(), k, m.end()))
        assert pii.base_spans(t) == sorted(want), t


def test_telling_terms(spark, frame):
    rng = random.Random(8)
    docs = [(i, f"{rng.choice(WORDS)} {rng.choice(WORDS)} contact zorblax {rng.choice(WORDS)} at jo@ex.org and {rng.choice(WORDS)}") for i in range(8)]
    docs += [(100 + i, " ".join(rng.choice(WORDS) for _ in range(30)) + " contact and at") for i in range(60)]
    rows = {r.doc_id: r for r in pii.find_personal_data(frame(docs)).collect()}
    t = docs[0][1]
    assert [t[s.start : s.end] for s in rows[0].terms] == ["zorblax"] and [s.kind for s in rows[0].base] == ["email"]
    assert all(not rows[i].terms for i in range(100, 160))
    safe = {r.doc_id: r.text for r in pii.sanitise(frame(docs)).collect()}
    assert "zorblax" not in safe[0] and "jo@ex.org" not in safe[0] and "<EMAIL>" in safe[0] and safe[100] == docs[8][1]


def test_terms_far_from_the_value_and_in_other_documents(spark, frame):
    rng = random.Random(9)
    some = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    docs = [(i, f"{some(8)} zorblax {some(60)} jo@ex.org {some(5)}") for i in range(20)]
    docs += [(50, f"{some(10)} Zorblax {some(10)}")] + [(100 + i, some(30)) for i in range(200)]
    rows = {r.doc_id: r for r in pii.find_personal_data(frame(docs)).collect()}
    for i, t in docs[:21]:
        assert [t[s.start : s.end].lower() for s in rows[i].terms] == ["zorblax"]
    assert not any(rows[i].terms for i, _ in docs[21:])
    safe = {r.doc_id: r.text for r in pii.sanitise(frame(docs)).collect()}
    assert not any("zorblax" in t.lower() for t in safe.values()) and all(safe[i] == t for i, t in docs[21:])


def test_document_frequencies_are_exact(spark, frame):
    docs = [(i, f"word{''.join(chr(97 + int(c)) for c in str(k))} Shared") for i in range(3) for k in range(100)]
    docs += [(i, f"{''.join(chr(97 + (k // 26**p) % 26) for p in range(4))}" + " x") for i, k in enumerate(range(0, 400_000, 40))]
    want = {}
    for _, t in docs:
        for w in set(re.findall(r"[^\W\d_]{3,}", t.lower())):
            want[w] = want.get(w, 0) + 1
    assert {r.term: r.df for r in pii.term_counts(frame(docs)).collect()} == want


# --- media -----------------------------------------------------------------


def _pictures(n, seed=0):
    patterns = media._patterns(64)
    return [media.picture(np.random.default_rng(seed + k).normal(size=64).astype(np.float32), patterns) for k in range(n)]


def _copies(spark, images):
    rows = spark.createDataFrame([(k, bytearray(media.pgm(i))) for k, i in enumerate(images)], "image_id long, media binary").withColumns({c: F.lit(None) for c in ("node", "digest", "corners", "n", "key")})
    return {r.image_id: r for r in media.find_copies(rows).collect()}


def test_copies_of_images(spark):
    a, *others = _pictures(14)
    images = [a, *(media.edited(a, e) for e in media.EDITS), a, *others]
    out = _copies(spark, images)
    assert all(out[k].class_id == 0 and out[k].class_size == 8 for k in range(8)), {k: r.class_id for k, r in out.items()}
    assert all(out[k].class_id == k and out[k].class_size == 1 for k in range(8, 21))


def test_recall_of_each_edit(spark):
    originals = _pictures(60, 100)
    images = [g for k, o in enumerate(originals) for g in (o, media.edited(o, media.EDITS[k % 6]))]
    out = _copies(spark, images)
    assert sum(out[2 * k + 1].class_id == 2 * k for k in range(60)) >= 0.9 * 60
    assert all(out[2 * k].class_id == 2 * k for k in range(60))


@pytest.mark.parametrize("crowd", [64, 1])
def test_classes_against_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(media, "CROWD", crowd)
    rng = np.random.default_rng(3)
    images = []
    for g in _pictures(4, 300):  # groups in which many images differ by noise, so that entries are crowded
        images += [np.clip(g + rng.normal(0, 6, g.shape), 0, 255) for _ in range(25)]
    out = _copies(spark, images)
    packed = [media.pack(media.describe(media.decode(media.pgm(g)))).reshape(-1, 3) for g in images]
    same, root = media.consensus(6, 12), list(range(len(images)))
    for i, p in enumerate(packed):
        for j, q in enumerate(packed[:i]):
            bits = np.bitwise_count(p[:, None, 1] ^ q[None, :, 1]) + np.bitwise_count(p[:, None, 2] ^ q[None, :, 2])
            if bits.min() <= media.SEED_BITS and same(packed[j].ravel(), p.ravel()) and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    assert {k: r.class_id for k, r in out.items()} == dict(enumerate(root))


def test_corners_of_other_pictures_seldom_meet_in_the_tables(spark):
    rng = np.random.default_rng(21)
    low = rng.integers(0, 1 << 32, 400)  # one value in a quarter of the bits, the others at random
    rows = [(k, [0, int(7 << 32 | x), int(y)]) for k, (x, y) in enumerate(zip(low, rng.integers(-(1 << 62), 1 << 62, 400), strict=True))]
    near = [(1000 + k, [0, rows[k][1][1] ^ 1 << 3 ^ 1 << 40, rows[k][1][2] ^ 1 << (k % 60)]) for k in range(40)]
    found = spark.createDataFrame(rows + near, "node long, corners array<long>")
    met = {}
    for r in rounds.meeting(media.table_rows(found)).collect():
        met.setdefault(r.key, set()).add(r.node)
    pairs = {(a, b) for g in met.values() for a in g for b in g if a < b}
    assert {(k, 1000 + k) for k in range(40)} <= pairs and len(pairs) < 100


def test_png_is_read():
    import struct

    g = np.arange(48, dtype=np.uint8).reshape(6, 8)
    raw = b"".join(b"\x01" + bytes([int(r[0])]) + bytes((int(r[k]) - int(r[k - 1])) % 256 for k in range(1, 8)) for r in g)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 6, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (media.decode(png) == g).all()
    rng = np.random.default_rng(0)
    want = rng.integers(0, 256, (5, 4, 3))
    lines, up = [], np.zeros((5, 3), int)
    for kind, row in enumerate(want):  # all five filters
        left = np.vstack((np.zeros((1, 3), int), row))
        a, b, c = left[:-1], up[1:], up[:-1]
        p = a + b - c
        paeth = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
        guess = [0 * a, a, b, (a + b) // 2, paeth][kind]
        lines.append(bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        up = left
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert np.allclose(media.decode(png), want @ np.array([0.299, 0.587, 0.114]), atol=1e-3)
    assert (media.decode(b"P5\n2 1\n100\n\x00\x64") == [[0, 255]]).all() and (media.decode(b"P5\n1 1\n65535\n\xff\xff") == 255).all()
    assert media.decode(b"P5\n99999 99999\n255\n") is None


# --- pipeline --------------------------------------------------------------


def test_pipeline_catches_planted_cases(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(1)
    base = texts(120, 11, 40, 80)
    passage = " ".join(f"secret{k}" for k in range(14))
    docs = [(i, t) for i, t in enumerate(base)]
    docs += [(200 + i, base[i]) for i in range(10)]  # exact copies
    docs += [(300, base[20] + " " + passage), (301, passage)]
    docs += [(400 + i, f"{t} idiot moron idiot") for i, t in enumerate(texts(60, 12, 20, 50))]
    docs += [(500, base[30] + " mail jo@ex.org now")]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(400 <= i < 500)) for i, _ in docs if rng.random() < 0.8], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    at = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, d).write.parquet(f"{d}/out{k}")
        at = spark.read.parquet(f"{d}/out{k}")
        kept[name] = {r.doc_id: r for r in at.collect()}
        if k < 4:
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = set(range(120))
    assert not any(400 <= i < 500 for i in kept["toxicity"]) and clean <= set(kept["toxicity"])
    assert not any(200 <= i < 210 for i in kept["simhash_near_dedup"])
    leaks = kept["benchmark_decontamination"]
    assert 301 not in leaks and (300 not in leaks or "secret" not in leaks[300].text)
    assert all(leaks[i].text == base[i] for i in clean if i in leaks) and len(clean - set(leaks)) <= 4
    if 500 in kept["personal_data"]:
        assert "jo@ex.org" not in kept["personal_data"][500].text
    assert set(kept["best_fit_packing"]) == set(kept["personal_data"])


def test_odd_cells_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(11)
    for n in (0, 1, 40, 400, 3000):
        for changed in (0, 1, n // 9, n):
            a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
            b = np.unique(np.concatenate((a[changed:], rng.integers(-(1 << 62), 1 << 62, changed))))
            cells = sum((x ^ y).bit_count() for x, y in zip(*([c & (1 << 64) - 1 for c in simhash.odd_cells(s)] for s in (a, b)), strict=True))
            assert cells <= len(np.setxor1d(a, b))
            if simhash.jaccard_at_least(0.8)(a, b):
                assert cells <= 0.2 / 1.8 * (len(a) + len(b)) + 1e-6
