"""The training-data operators on texts: brute force, exact round trips, edge cases."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sediment.llm import boost, garbled, language, mixing, seen, tokenizer, transcripts

EN = "the old catalogue stops at the first damaged block because the disk was full and nobody had opened that folder"
DE = "der alte katalog bricht beim ersten beschädigten block ab weil die platte voll war und niemand hat diesen ordner geöffnet"
PT = "o catálogo antigo pára no primeiro bloco danificado porque o disco estava cheio e ninguém abria essa pasta há anos"


def text_of(words, rnd, n=4):
    return " ".join(" ".join(rnd.sample(words.split(), 9)).capitalize() + "." for _ in range(n))


def layers(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(90):
        lang, words = (("en", EN), ("de", DE), ("pt-BR", PT))[i % 3]
        rows.append((f"{i:064x}", 0, "ocr", lang, text_of(words, rnd)))
    rows += [
        ("a" * 64, 0, "ocr", None, text_of(DE, rnd)), ("b" * 64, 0, "ocr", "German", text_of(EN, rnd)), ("c" * 64, 0, "description", "en", text_of(EN, rnd, 2) + "\n" + text_of(PT, rnd, 2)),
        ("d" * 64, 0, "ocr", "English", text_of(EN, rnd)), ("e" * 64, 0, "ocr", "de", None), ("f" * 64, 0, "ocr", "de", ""), ("1" * 64, 0, "ocr", "xx", "[music]\n00:00:01"), ("a" * 64, 0, "ocr", None, "x " * 300_000),
        ("2" * 64, None, None, None, None),
    ]
    return spark.createDataFrame([(*r, "x", 1.0) for r in rows], "sha256 string, n int, kind string, language string, content string, lang string, confidence double")


def test_language(spark):
    df = layers(spark)
    out = language.languages(df, ["sha256", "n"], "content", "language", "kind").filter("n_langs > 1 or not coalesce(named, false)")
    got = {(r.sha256[0], r.lang) for r in out.filter("length(sha256) = 64 and sha256 rlike '^(.)\\\\1+$'").collect()}
    assert {("a", "de"), ("b", "en"), ("c", "en"), ("c", "pt")} <= got and not {x for x in got if x[0] in "def1"}
    segments = language.languages(df.filter(F.col("sha256") == "c" * 64), ["sha256", "n"], "content", "language", "kind", model=language.train(df, "content", "language", "kind"), segments=True)
    assert [(r.segment, r.lang) for r in segments.orderBy("segment").collect()] == [(0, "en"), (1, "pt")]
    assert segments.filter("confidence < 0 or confidence > 1").count() == 0


def test_language_empty(spark):
    df = layers(spark).filter(F.lit(False))
    assert language.languages(df, ["sha256", "n"], "content", "language", "kind").count() == 0
    assert language.languages(layers(spark).withColumn("language", F.lit(None).cast("string")), ["sha256", "n"], "content", "language", "kind").count() == 0


def test_language_codes():
    for label, code in (("en-GB", "en"), ("PT_br", "pt"), ("Deutsch", "de"), ("fre", "fr"), ("UK", "uk"), ("русский", "ru"), ("und", None), ("", None), (None, None), ("xx", None)):
        assert language.code_of(label) == code


def test_transcript_parse_and_persons():
    srt = "1\n00:00:10,000 --> 00:00:12,000\nAnna Berg: one two\nthree\n\n2\n00:00:01,000 --> 00:00:05,000\nB. Holm: zero\n"
    assert [(s.time, s.label, s.text) for s in transcripts.parse(srt)] == [(1.0, "B. Holm", "zero"), (10.0, "Anna Berg", "one two\nthree")]
    for text, want in (
        ("[0:05] S1: hi", (5.0, "S1", "hi")), ("Ann Lee (00:00:07): hi", (7.0, "Ann Lee", "hi")), ("0:09 - Ann Lee - hi there", (9.0, "Ann Lee", "hi there")), (">> ANN: hi", (None, "ANN", "hi")),
        ("WEBVTT\n\n00:01.000 --> 00:02.000\n<v Ann>hi", (1.0, "Ann", "hi")), ("12.5s\n>> Ann: hi", (12.5, "Ann", "hi")), ("One thing is clear: hi", (None, None, "One thing is clear: hi")),
    ):
        s = transcripts.parse(text)[0]
        assert (s.time, s.label, s.text) == want
    who = transcripts.persons(["Anna Berg", "BERG", "A. Berg", "Anna B.", "Dr. Berg", "Anna Breg", "AB", "Carl Holm", "carl", None, "S1", "Speaker 1", "SPEAKER_02"][:8] + ["CARL", None, "S1", "Speaker 1", "SPEAKER_02"])
    assert len(set(who[:7])) == 1 and who[7] == who[8] and who[9] is None and who[10] == who[11] != who[12]


def test_transcript_turns(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(60):
        lines = []
        for k in range(8):
            words = rnd.sample(EN.split(), 10)
            words.insert(rnd.randrange(1, 9), rnd.choice(["um...", "– uhh –", "um,", "uh"]))
            lines.append(f"[00:00:{k * 5:02d}] {('Ann Lee', 'Bob Ray')[k % 2]}: {' '.join(words)}. [cough]")
        rows += [(f"t{i}", 0, "transcript", "en", "\n".join(lines)), (f"o{i}", 0, "ocr", "en", text_of(EN, rnd)), (f"d{i}", 0, "ocr", "de", text_of(DE, rnd))]
    rows += [("n", 0, "transcript", "en", None), ("e", 0, "transcript", "en", ""), ("m", 0, "transcript", "en", "[music]\n[00:00:01] ..."), ("t0", 0, "transcript", "en", rows[0][4])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "sha256 string, n int, kind string, language string, content string, turn int")
    out = transcripts.turns(df, ["sha256", "n"], "content", "language", "kind").collect()
    assert len(out) == 60 * 8 and {r.words for r in out} == {10} and {r.sha256[0] for r in out} == {"t"}
    assert {(r.turn, r.speaker) for r in out} == {(k + 1, k % 2 + 1) for k in range(8)}
    assert transcripts.turns(df.filter(F.lit(False)), ["sha256", "n"], "content", "language", "kind").count() == 0


def test_hesitation_sounds_of_more_data(spark):
    # the same shares must tell the same sounds, however much there is: some sounds begin with a capital, any word may once stand beside
    # a pause, some words are only spoken; the many rare names must not hide the few sounds
    rnd = random.Random(4)
    sounds = {"en": {"um", "uh", "erm"}, "de": {"öh", "ähm"}}
    words = [(lang, "".join(rnd.sample("abcdefghijklmnoprst", rnd.randrange(2, 7)))) for lang in sounds for _ in range(1500)]
    for times in (1, 10, 1000):
        rows = {(lang, f): (1600 * times, 0, 570 * times, 30 * times) for lang, fs in sounds.items() for f in fs}
        for i, (lang, w) in enumerate(words):
            a = (60 if i % 50 else 500) * times
            rows.setdefault((lang, w), (a, 0 if i % 50 == 1 else a, a // 5000, 0 if i % 50 < 2 else a // 3))
        for lang in sounds:
            rows[lang, ""] = (*(sum(v[j] for k, v in rows.items() if k[0] == lang) for j in range(3)), 0)
        # one written sentence in millions taken for the other language
        rows["de", "um"] = (800 * times, 800 * times, 0, 0)
        rows["en", "ähm"] = (0, times // 1000, 0, 0)
        counted = spark.createDataFrame([(*k, *v) for k, v in rows.items()], "lang string, form string, a bigint, b bigint, p bigint, k bigint")
        fillers, written = transcripts._fillers(counted)
        assert fillers == sounds and written == {("de", "um")}


def test_transcript_time_beside_a_note():
    # a time without brackets is no word where only sound notes stand beside it; before speech it is left as it stands
    assert transcripts.parse("00:00:00 (music)") == []
    assert [(s.time, s.label, s.text) for s in transcripts.parse("Ann: one\n00:07 [door closes] ♪ la ♪\ntwo")] == [(-1.0, "Ann", "one"), (7.0, None, "two")]
    assert [s.text for s in transcripts.parse("Ann: we met at\n10:30 (sharp) at the gate")] == ["we met at\n10:30 (sharp) at the gate"]


def test_trees_of_a_rare_class():
    # a class of few rows, far likelier by weight than its neighbours, is found beside many rows of the other
    rnd = np.random.default_rng(7)
    for n in (500, 5_000, 50_000):
        x = np.concatenate([rnd.normal(0, 1, n), np.full(20, 8.0) + rnd.random(20)])[:, None]
        y = np.arange(len(x)) >= n
        said = boost.fit(x, y, weight=np.full(len(x), 50.0)).probability(x) > 0.5
        assert (said == y).all()


def test_people_and_boundaries():
    # a shortened name goes to the person one of whose forms it fits exactly, not to one a letter away
    assert len(set(transcripts.persons(["Dr. Rador", "Jorlo Sador", "Yor Raodr", "Y. Rador"])[i] for i in (0, 2, 3))) == 1
    assert len(set(transcripts.persons(["Olsel N.", "O. Nota", "Olsel"]))) == 1
    rnd = random.Random(3)
    names = ["Anna Berg", "Carl Holm", "Dora Lind", "Egon Falk"]
    texts = []
    for _ in range(120):
        who = rnd.sample(names, 3)
        texts.append("\n".join(f"[00:{k:02d}:00] {rnd.choice(who)}: {' '.join(rnd.sample(EN.split(), 8))}." for k in range(12)))
    xs, ys, _ = (sum(x, []) for x in zip(*map(transcripts.training_rows, texts[:80]), strict=True))
    trees = boost.fit(np.array(xs, float), np.array(ys))
    quality = transcripts.boundary_quality(trees, texts[80:])
    assert min(quality["trees"]) > 0.97 and quality["trees"][0] >= quality["labels"][0] - 0.01


def test_language_of_a_long_text(spark):
    df = layers(spark)
    model = language.train(df, "content", "language", "kind")
    long = " ".join([DE] * 9000)
    assert model.classify_all([EN, "", long, PT])[2][::2] == ("de", len(language._WORD.findall(long)))
    assert [x[0] for x in model.classify_all([EN, "", "123", PT])] == ["en", None, None, "pt"]
    some = language.sample_of(df, "content", F.col("kind"), language.code_column(F.col("language")), 5)
    assert 0 < some.filter("label = 'de'").count() < 25 and set(some.columns) == {"content", "kind", "label"}


def test_boost():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int)
    m = boost.fit(x[:2000], y[:2000])
    assert ((m.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    assert boost.fit(np.zeros((5, 2)), np.ones(5)).probability(np.zeros((2, 2))).min() > 0.5


@pytest.mark.parametrize("bits", [0, 12, 48])
def test_elias_fano(bits):
    rnd = np.random.default_rng(bits)
    for n in (0, 1, 3, 500):
        v = np.unique(rnd.integers(0, max(1, 2**bits), n, dtype=np.uint64))
        e = seen.EliasFano.of(v, bits)
        assert (e.values() == v).all()
        probe = np.unique(np.concatenate([v[:50], rnd.integers(0, max(1, 2**bits), 50, dtype=np.uint64)]))
        assert (e.contains(probe) == np.isin(probe, v)).all()
        m = e.merged(probe)
        assert (m.values() == np.union1d(v, probe)).all()


def test_seen_before(spark):
    rnd = random.Random(9)
    hot = bytes([7]) * 32
    keys = [hashlib.sha256(bytes([i])).digest() for i in range(60)]
    history = [None, *keys[:20], *keys[:5]]
    incoming = [(i, rnd.choice([None, hot, hot, *keys[10:]])) for i in range(400)]
    h = spark.createDataFrame([(None if k is None else bytearray(k), 1) for k in history], "sha256 binary, seq int")
    r = spark.createDataFrame([(i, None if k is None else bytearray(k), "x") for i, k in rnd.sample(incoming, 400)], "seq bigint, key binary, first string")
    known, want = {k for k in history if k}, []
    for i, k in incoming:
        if k is not None:
            if k in known:
                want.append(i)
            known.add(k)
    for bits in (48, 6):  # at 6 bits the coded set alone is often wrong; the exact check mends it
        found, answers = seen.seen_before(h, "sha256", r, "key", "seq", bits)
        assert sorted(x.seq for x in found.collect()) == want
        rate = seen.wrong_answers(answers, len(history), bits).first()
        assert (rate.wrong > 0) == (bits == 6)
    assert seen.seen_before(h.filter(F.lit(False)), "sha256", r, "key", "seq")[0].count() == sum(k is not None for _, k in incoming) - len({k for _, k in incoming if k})
    assert seen.seen_before(h, "sha256", r.filter(F.lit(False)), "key", "seq")[0].count() == 0
    assert answers.filter("not fresh and not seen").count() == 0  # a key that came in with an earlier batch is found in the coded sets
    assert answers.groupBy("key").count().agg(F.max("count")).first()[0] <= seen.BATCHES
    coded = seen.merge_batch(seen.build_filter(h, "sha256", 8), r, "key", 8)
    assert coded.agg(F.sum("n")).first()[0] == len(known)


def test_layers_of_coded_sets():
    rnd = np.random.default_rng(7)
    sets, held = seen.Layers(seen.EliasFano.of(np.zeros(0, np.uint64), 20)), np.zeros(0, np.uint64)
    for n in (5, 100, 3, 0, 40, 700, 1, 60):
        v = np.unique(rnd.integers(0, 2**20, n, dtype=np.uint64))
        assert (sets.contains(v) == np.isin(v, held)).all()
        sets.add(v)
        held = np.union1d(held, v)
    assert sets.contains(held).all() and len(sets.sets) < 6


def test_digest_notations(spark):
    d = hashlib.sha256(b"x").digest()
    import base64

    h, b = d.hex(), base64.b64encode(d).decode()
    grouped = " ".join(h[i : i + 8] for i in range(0, 64, 8))
    good = [h, h.upper(), f" {h}\n", f"sha256:{h}", "\\x" + h, grouped, ":".join(h[i : i + 2] for i in range(0, 64, 2)).upper(), f"sha256-{b}", "0x" + h]
    bad = [None, "", h[:-1], h + h[:8], h[:32] + "xyz" + h[35:], "pending", h[:40], "g" * 64]
    df = spark.createDataFrame([(x,) for x in good + bad], "s string").select(seen.digest_key(F.col("s")).alias("k"))
    assert [None if r.k is None else bytes(r.k) for r in df.collect()] == [d] * len(good) + [None] * len(bad)


def test_tokenizer(spark):
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{tokenizer.TOKENIZERS}/byte_bpe_50k.json")
    lib.encode_special_tokens = True
    a = tokenizer.Automaton(tokenizer.load_vocabulary(f"{tokenizer.TOKENIZERS}/byte_bpe_50k.json"))
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcdefgh  étz\n\t 1239'sd.,-=аб中😀fs") for _ in range(rnd.randint(1, 80))) for _ in range(1500)]
    texts += ["a" * 3000, "-" * 2000, " " * 2000 + "x", "<|endoftext|>", "\x1c\x85​", "ab" * 2000]
    for t in texts:
        ids = a.encode(t)
        assert ids == lib.encode(t, add_special_tokens=False).ids and a.decode(ids) == t
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "hello world", 0), (3, "hello world", 0), (None, "x", 0)], "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id or 0), list(r.ids)) for r in tokenizer.encode(df, "doc_id", "text").collect())
    assert got == [(0, a.encode("x")), (1, []), (2, []), (3, a.encode("hello world")), (3, a.encode("hello world"))]
    assert tokenizer.encode(df.filter(F.lit(False)), "doc_id", "text").count() == 0


def test_other_vocabulary():
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    path = f"{tokenizer.TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    a = tokenizer.Automaton(tokenizer.load_vocabulary(path))
    for t in (EN, DE, PT, "Старий каталог", "目录 読む"):
        assert a.encode(t) == lib.encode_ordinary(t)


def test_rake():
    rnd = np.random.default_rng(3)
    source, lang = np.repeat(np.arange(3), 4), np.tile(np.arange(4), 3)
    tokens = rnd.integers(50, 500, 12).astype(float)
    cap = np.array([1.0, 2.0, 6.0])
    want = np.array([0.5, 0.3, 0.2]) * 600
    x = mixing.rake(tokens, source, [(lang, np.full(4, 0.25))], want, cap)
    assert np.allclose(np.bincount(source, x), want) and (x <= tokens * cap[source] + 1e-9).all()
    assert np.abs(np.bincount(lang, x) / x.sum() - 0.25).max() < 0.02


def test_mixture(spark):
    rnd = random.Random(4)
    docs = [(i, rnd.choice(["a", "A ", "b", "c", None, "zz"]), rnd.choice(["en", "de", None]), rnd.choice(["x", "y"]), rnd.randint(0, 60)) for i in range(4000)]
    df = spark.createDataFrame([(i, s and s.strip().lower(), lang, t, n, 1) for i, s, lang, t, n in docs], "doc bigint, source string, lang string, topic string, tokens bigint, copies int")
    goal = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 4), ("none", 0.1, 3), (None, 0.5, 1), ("q", -1.0, 1)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mixture(df, goal)
    rows = {r.source: r for r in report.collect()}
    assert set(rows) == {"a", "b", "c", "none"} and rows["none"].tokens == 0
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(rows[s].actual_share - share / 0.9) < 0.002 and rows[s].max_copies <= rows[s].max_repeats
    assert mix.filter("tokens = 0 or copies < 1").count() == 0 and mix.groupBy("doc").count().filter("count > 1").count() == 0
    mix, report = mixing.mixture(df.filter(F.lit(False)), goal)
    assert mix.count() == 0 and {r.actual_share for r in report.collect()} == {0.0}
    assert mixing.mixture(df, goal.filter(F.lit(False)))[0].count() == 0


GOOD = ["Das Café öffnet früh – „endlich“ für alle.", "La última página está vacía…", "Ключ от тома читает блоки в неверном порядке.", "Prüfsumme größer als 20 °C", "ça coûte 5 € déjà"]


def test_garbled_pairs():
    counts = {w: 50 for t in GOOD for w in map(str.lower, language._WORD.findall(t)) if not w.isascii()}
    r = garbled.Restorer(counts)
    for t in GOOD:
        assert r.restore(t)[1] is False, t
        for x in ("web", "latin-1", "cp437", "cp850", "mac_roman", "cp1251"):
            wrong = "".join(c if ord(c) < 128 else "".join(garbled.tables(x)[0].get(b) or "\0" for b in c.encode()) for c in t)
            if "\0" not in wrong:
                assert r.restore(wrong) == (t, True, False), (x, wrong)
                assert r.restore(GOOD[0] + "\n" + wrong)[0] == GOOD[0] + "\n" + t
                if x == "cp1251":
                    continue
                twice = "".join(c if ord(c) < 128 else "".join(garbled.tables("web")[0].get(b) or "\0" for b in c.encode()) for c in wrong)
                assert r.restore(twice) == (t, True, False), (x, twice)
    for true, wrong in (("web", "cp437"), ("web", "mac_roman"), ("cp1251", "web"), ("cp1251", "koi8-r")):
        for t in GOOD:
            g = garbled.swap(t, true, wrong)
            if g is not None and g != t:
                assert r.restore(g) == (t, True, False), (true, wrong, g)


def test_garbled_signs():
    counts = {w: 50 for t in GOOD for w in map(str.lower, language._WORD.findall(t)) if not w.isascii()}
    r = garbled.Restorer(counts, {" é ": 900, "": 900})
    wrong = lambda t, x: "".join(c if ord(c) < 128 else "".join(garbled.tables(x)[0][b] for b in c.encode()) for c in t)
    for t in ("The index holds “27” entries – no more.", "It takes about „paths,“ so — it says."):
        for true, other in (("web", "mac_roman"), ("web", "cp437")):
            g = garbled.swap(t, true, other)
            if g:
                assert r.restore(g) == (t, True, False), g
    t = "Das Café öffnet früh (±5 %), «endlich,» sagt er (½)."
    assert r.restore(wrong(t, "cp437")) == (t, True, False)
    t = "Le café est déjà fermé, trouvés à Lille."
    assert r.restore(wrong(t, "web").replace("\xa0", " ").replace("dÃ©jÃ ", "dÃ©jÃ\xa0")) == (t, True, False)
    for t in ("galven/\n├── a.txt\n└── b/ ┬▒", "Ñandú ë o í, à é", "┌──────┬──────┐\n│ 5 │"):
        assert r.restore(t)[1] is False, t


def test_garbled_rows(spark):
    shown = ["The viewer shows “Ã©” where the file has “é”, and “â€™” for an apostrophe.", "Bytes C3 A9 shown as Latin text give Ã© (see §91).", "galven/\n├── a.txt\n└── b/", "ATENÇÃO: NÃO HÁ CÓPIA. REVISÃO Â."]
    rows = [(1, None), (2, ""), (3, "plain"), (4, "La cafÃ© est lÃ ".replace("lÃ ", "lÃ\xa0")), (5, "caf� noir"), (6, "x" * 300_000 + " cafÃ©"), (6, "x" * 300_000 + " cafÃ©"), *((10 + i, t) for i, t in enumerate(shown)), *((20 + i, t) for i, t in enumerate(GOOD))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, restored_md5 string")
    got = {(r.doc_id, r.restored_md5) for r in garbled.restore(df, "doc_id", "text").collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert got == {(4, md5("La café est là")), (5, ""), (6, md5("x" * 300_000 + " café"))}
    assert garbled.restore(df.filter(F.lit(False)), "doc_id", "text").count() == 0


def test_garbled_copies(spark):
    good = "Ключ от тома читает блоки в неверном порядке и каталог"
    copied = garbled.swap(good, "cp1251", "web")
    latin = "La última página está vacía aquí"
    rows = [*((i, f"{good} {i}") for i in range(4)), *((100 + i, copied) for i in range(40)), *((200 + i, f"{latin} {i}") for i in range(4)), *((300 + i, garbled.swap(latin, "web", "mac_roman")) for i in range(40))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert garbled.frequent_words(df, "text", docs=1)[garbled.swap("тома", "cp1251", "web")] == 1  # equal texts count once
    got = {(r.doc_id, r.restored_md5) for r in garbled.restore(df, "doc_id", "text").collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert got == {(r, md5(t)) for r, t in [*((100 + i, good) for i in range(40)), *((300 + i, latin) for i in range(40))]}


def test_garbled_rare_words(spark):
    rnd = random.Random(8)
    stems, ends = ["катал", "архив", "читат", "книж", "блок", "перед", "стран", "запис"], ["ами", "ного", "ение", "ость", "ыми", "овать"]
    rows = [(i, " ".join(rnd.choice(stems) + rnd.choice(stems) + rnd.choice(ends) for _ in range(12)) + ".") for i in range(300)]
    rare = "Архивкаталблокение странпередзаписость книжкаталстранами."
    wrong = [(1000 + i, garbled.swap(rare, *pair)) for i, pair in enumerate((("cp1251", "web"), ("cp1251", "koi8-r")))]
    df = spark.createDataFrame(rows + wrong + [(2000, rare)], "doc_id bigint, text string")
    held = garbled.frequent_words(df, "text")
    assert not {w.lower().strip(".") for w in rare.split()} & set(held)
    got = {(r.doc_id, r.restored_md5) for r in garbled.restore(df, "doc_id", "text").collect()}
    assert got == {(i, hashlib.md5(rare.encode()).hexdigest()) for i, _ in wrong}


def test_garbled_form_more_frequent_than_its_word():
    words = "ключ тома читает блоки неверном порядке".split()
    counts = dict.fromkeys(words, 50) | {garbled.swap(w, "cp1251", "web").lower(): 900 for w in words}
    r = garbled.Restorer(counts)
    t = "Ключ тома читает блоки в неверном порядке."
    assert r.restore(garbled.swap(t, "cp1251", "web")) == (t, True, False) and r.restore(t)[1] is False


def test_queries_are_registered():
    from sediment.llm.queries import oracle_sql, queries

    assert {"p1_found", "p2_found", "p4_found", "p6_ids", "p7_mixture", "p8_found"} <= set(queries()) and set(oracle_sql()) <= set(queries())
    json.dumps(oracle_sql())
