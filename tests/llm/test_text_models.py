import random
import re

import numpy as np
import pyspark.sql.functions as F

from pathloom.llm import decontaminate, language_id, pii, toxicity
from pathloom.llm.decontaminate import Items, contaminated, edit_distance, words_of
from pathloom.llm.language_id import identify_languages
from pathloom.llm.pii import ORDER, base_spans, find_spans, luhn, made_up, mask_pii, mask_spans, pii_spans, trained_field
from pathloom.llm.toxicity import fit_toxicity, reject_toxic, score_toxicity

SYLLABLES = "an ber co der en fi gra ho in ka lo mi nen os pre qua re sa tion un ver wo".split()


def prose(draw, n, syllables=SYLLABLES):
    return " ".join("".join(draw.choice(syllables) for _ in range(draw.randint(1, 3))) for _ in range(n))


def test_edit_distance_band():
    draw = random.Random(1)

    def full(a, b):
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1)
        return d[-1, -1]

    for _ in range(300):
        a, b, most = [draw.randrange(4) for _ in range(draw.randrange(12))], [draw.randrange(4) for _ in range(draw.randrange(12))], draw.randrange(6)
        assert edit_distance(a, b, most) == min(full(a, b), most + 1)


def test_decontamination_against_brute_force(spark):
    draw = random.Random(2)
    items = [(i, prose(draw, draw.randint(12, 30))) for i in range(15)] + [(90, None), (91, "only few words"), (92, "")]
    docs, planted = [], 0
    for i in range(60):
        words = prose(draw, 60).split()
        if i % 3 == 0:
            passage = items[i % 15][1].split()
            for _ in range(draw.randrange(int(0.3 * len(passage)))):
                passage[draw.randrange(len(passage))] = draw.choice(["zzz", "yyy"])
            words[20:20] = passage
            planted += 1
        docs.append((i, " ".join(words).title() + ".", "x"))
    docs += [(100, None, "x"), (101, "", "x"), (None, items[0][1], "x"), (102, prose(draw, 20) + " Only few words, " + prose(draw, 20), "x"), (103, "only many words", "x"), (102, "repeated rows", "x")]
    want = set()
    for key, text, _ in docs:
        w = words_of(text or "")
        for item, t in items:
            own = words_of(t or "")
            n, most = len(own), int(0.2 * len(own) + 1e-9)
            if n and any(edit_distance(w[s : s + n], own, most) <= most for s in range(len(w) - n + 1)):
                want.add((key, item))
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 10 and len(found) == len(got)
    assert contaminated(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_recall_at_the_bound():
    draw = random.Random(5)
    rows = [(i, prose(draw, draw.randint(15, 59)).split()) for i in range(400)]
    items = Items(rows, 0.8)
    found = total = 0
    for k, (_, words) in enumerate(rows):
        edited = list(words)
        for at in draw.sample(range(len(words)), items.most[len(words)]):
            edited[at] = "qqq"
        numbers = items.number(edited)
        total += 1
        found += any(item == k for _, item, _, _ in items.find(numbers, np.full(len(numbers), len(numbers))))
    print("recall at the bound", found / total)
    assert found >= 0.97 * total


def test_passages_with_words_put_in_or_dropped(spark):
    draw = random.Random(6)
    items = [(i, prose(draw, draw.randint(20, 59))) for i in range(30)]
    docs, planted = [], {}
    for i, (_, text) in enumerate(items * 4):
        passage, kind = text.split(), i // 30
        most = int(0.2 * len(passage) + 1e-9)
        for _ in range(most):
            at = draw.randrange(1, len(passage) - 1)
            passage[at : at + kind % 2] = [] if kind % 2 else ["qqq"]
        around = [prose(draw, 40), prose(draw, 40)] if kind < 2 else ["", ""]
        docs.append((i, " ".join([around[0], *passage, around[1]])))
        planted[i, i % 30] = most
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r for r in found}
    assert set(got) <= set(planted) and len(got) >= 0.97 * len(planted)
    for (doc, item), r in got.items():
        passage, own = words_of(docs[doc][1])[r["start"] : r["end"]], words_of(items[item][1])
        assert r["distance"] <= planted[doc, item] and edit_distance(passage, own, 99) == r["distance"] and r["item_words"] == len(own)


def plain_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    spans = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    spans += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    spans += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    spans += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(spans, key=lambda s: (s[0], ORDER[s[2]]))


def test_base_spans_are_the_patterns():
    draw = random.Random(3)
    bits = ["1", "23", ".", "@", "a", "b.c", "-", " ", "+", "(", ")", "4111111111111111", "255", "é", "\n", "..", "com", "0000"]
    for _ in range(6000):
        text = "".join(draw.choice(bits) for _ in range(draw.randint(0, 25)))
        assert base_spans(text) == plain_spans(text), text
    base_spans("1" * 300_000), base_spans("a" * 300_000 + "@"), base_spans("1." * 100_000)


def test_field_on_new_sentences_and_odd_rows(spark):
    field = trained_field()
    cases = made_up(77, 120)
    hit = sum(len(set(field.decode(t)) & set(s)) for t, s in cases)
    assert hit >= 0.8 * sum(len(s) for _, s in cases)
    base, every = find_spans('mail a.b@c.de token = "0641917ea4e9feb9cda83477b57ac2654884f485" x', field)
    assert base == [(5, 13, "email")] and [s for s in every if s[2] == "secret"] == [(23, 63, "secret")]
    docs = spark.createDataFrame([(1, "a@b.cc", "k"), (None, None, "k"), (1, "", "k")], "doc_id long, text string, spans string")
    assert sorted(len(r["spans"]) for r in pii_spans(docs).collect()) == [0, 0, 1]
    assert {r["text"] for r in mask_pii(docs).collect()} == {"<EMAIL>", None, ""}
    assert mask_spans("ab 1.2.3.4 c", [(3, 10, "ip"), (3, 8, "card")]) == "ab <IP> c"


def test_addresses_without_a_digit():
    field = trained_field()
    for address in ("jane [at] example [dot] org", "jane at example dot org", "jane(at)example(dot)com", "Jane.Doe (at) example.net", "sam at mail dot example dot com"):
        text = f"please write to {address} for more of it"
        assert find_spans(text, field) == ([], [(16, 16 + len(address), "email")]), address
    for text in ("we looked at the dot product of both", "she was at home (at last) and slept"):
        assert find_spans(text, field) == ([], []), text


def test_toxicity(spark):
    draw = random.Random(4)
    rows = [(i, prose(draw, 60) + (f" {draw.choice(['dumbkopf', 'vilrat'])}{draw.choice(SYLLABLES)} " + prose(draw, 20) if i % 4 == 0 else "")) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), None) for i in range(700)] + [(None, 1, None), (5000, None, None)], "doc_id long, toxic int, text string")
    scored = score_toxicity(docs, labels).filter("held_out").collect()
    right = sum((r["doc_id"] % 4 == 0) == bool(r["predicted"]) for r in scored)
    assert right >= 0.95 * len(scored)
    odd = spark.createDataFrame([(1, None, 1), (None, "", 2), (None, "", 2)], "doc_id long, text string, score int")
    assert len({r["score"] for r in score_toxicity(odd, labels, train_docs=docs).collect()}) == 1
    assert score_toxicity(odd, labels.limit(0)).count() == 3
    assert reject_toxic(docs, labels).filter(F.col("doc_id") % 4 == 0).count() <= 20


def test_gapped_words():
    draw = random.Random(6)
    texts = [prose(draw, 50) + (" dumbkopf" if i % 2 else "") for i in range(200)]
    model = fit_toxicity(texts, [i % 2 for i in range(200)])
    clean, bad, gapped, spaced, grown = model.scores(["gra ho in", "gra dumbkopf in", "gra d-u-m-b-k-o-p-f in", "gra d u m b k o p f in", "gra dumbxkopf in"])
    assert clean < 0.3 <= min(bad, gapped, spaced, grown)
    assert fit_toxicity([], []).scores(["x", None])[0] < 0.3


def test_languages(spark):
    draw = random.Random(7)
    kinds = {"en": "the and ing tion er on th".split(), "de": "ung keit der sch ein ich ver".split(), "fr": "eau que les ment oux tre ai".split(), "es": "ción los que ado ez la mente".split(), "xx": "wak zul umb ngo tsa".split()}
    rows = [(i, prose(draw, 30, kinds[k]), k) for i in range(600) for k in [list(kinds)[i % 5]]] + [(None, None, "en"), (9001, "123 !!", "en"), (9002, "", None)]
    out = identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    real = {r[0]: r[2] for r in rows}
    tested = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 9000]
    assert sum(r["lang_pred"] == real[r["doc_id"]] for r in tested) >= 0.97 * len(tested)
    assert {r["lang_pred"] for r in out if r["doc_id"] is None or r["doc_id"] >= 9000} == {"und"} and all(0 <= r["score"] <= 1 for r in out)
    empty = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert identify_languages(empty).first()["lang_pred"] == "und" and identify_languages(empty.limit(0)).count() == 0


def test_long_tokens_stay_whole_and_added_spans_apart():
    field = trained_field()
    for size in (40, 120, 5_000):
        text = "the key: " + "a1" * (size // 2) + " and more words follow here"
        added = find_spans(text, field)[1]
        assert all((s, e) == (9, 9 + size) for s, e, _ in added if s < 9 + size), added
    assert find_spans("a" * 300_000 + "7" + "b" * 300_000, field)[1] is not None
    draw = random.Random(3)
    parts = ["john.smith at example dot com", "call (212) 555-0143", "10.0.0.1", "key: 9f8e7d6c5b4a39281706", "word", "mit dem", "@", "1", "7" * 90, "x" * 100, "4111 1111 1111 1111", "[at]", "."]
    for _ in range(400):
        text = " ".join(draw.choice(parts) for _ in range(draw.randint(1, 30)))
        base, every = find_spans(text, field)
        added = sorted(set(every) - set(base))
        assert all(a[1] <= b[0] for a, b in zip(added, added[1:], strict=False)), (text, added)
        assert all(e <= a[0] or a[1] <= s for a in added for s, e, _ in base)


def test_kernel_is_the_sum_over_subsequences():
    from pathloom.llm import toxicity

    def explicit(word):
        codes = [toxicity.START, *[toxicity._code(ord(c)) for c in word], toxicity.END]
        found = {}
        for j, k, last, weight in toxicity.SHAPES:
            for p in range(len(codes) - last):
                key = (codes[p], codes[p + j], codes[p + k], codes[p + last])
                found[key] = found.get(key, 0) + weight
        return found

    def dense(index, weight):
        out = np.zeros(1 << toxicity.BITS, dtype=np.float64)
        np.add.at(out, index, weight)
        return out

    words = ["stupid", "st-upid", "s.t.u.p.i.d", "stup1d", "lovely", "river", "a", "aa", "gardenpath"]
    made = [dense(*v) for v in toxicity.vectors(words)]
    for a, x in zip(words, made, strict=True):
        for b, y in zip(words, made, strict=True):
            one, two = explicit(a), explicit(b)
            want = sum(w * two.get(key, 0) for key, w in one.items()) / (toxicity.NORMS[len(a) + 2] * toxicity.NORMS[len(b) + 2])
            assert abs(x @ y - want) < 0.02 * max(1.0, want), (a, b)
    near, far = made[0] @ made[1], made[0] @ made[4]
    assert near > 3 * far  # a character put in costs less than another word


def test_long_texts_are_decoded_in_windows(monkeypatch):
    """Windows of any size give the same entities, and the same features as segment by segment."""
    field, draw = trained_field(), random.Random(6)
    letters = "0123456789" * 3 + "abcdefXYZ .,;:@()[]+-_=/\n" + "éİKß中\u00a0\u2003"
    texts = [t for t, _ in made_up(9, 60)] + ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 300))) for _ in range(60)]
    whole = [field.decode(t) for t in texts]
    for text in texts:
        tokens = [m.span() for m in pii._TOKEN.finditer(text)]
        segments = pii.candidates(text, tokens)
        if segments:
            i, j = np.array(segments).T
            spans = np.array(tokens)
            each = np.array([pii.segment_features(text, tokens, a, b) for a, b in segments])
            assert (pii.window_features(text, pii._Counts(text), 0, spans[i, 0], spans[j - 1, 1], j - i) == each).all()
    monkeypatch.setattr(pii, "WINDOW_TOKENS", 3)
    monkeypatch.setattr(pii, "WINDOW_CHARS", 40)
    assert [field.decode(t) for t in texts] == whole
    monkeypatch.undo()
    assert len(field.decode("call +1 (212) 555-0199 or " * 5_000)) >= 5_000
    assert find_spans("a1" * 200_000, field)[0] == []


def test_no_documents_no_spans(spark):
    assert pii_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert mask_pii(spark.createDataFrame([], "text string")).collect() == []


def test_folded_table_is_the_kernel_expansion(monkeypatch):
    """Every word's margin from the folded table equals its kernel row times the weights of the SVM over the landmarks."""
    seen, solved = [], []
    vectors, solve = toxicity.vectors, toxicity.newton_svm
    monkeypatch.setattr(toxicity, "vectors", lambda words: (seen.append(words), vectors(words))[1])
    monkeypatch.setattr(toxicity, "newton_svm", lambda x, y: (solved.append((x, solve(x, y))), solved[-1][1])[1])
    draw = random.Random(8)
    word = lambda letters: "".join(draw.choice(letters) for _ in range(draw.randrange(3, 12)))
    model = toxicity.fit_words([word("xyzq") for _ in range(30)], [word("abcdefgé") for _ in range(60)], 24, 3)
    x, w = solved[0]
    assert np.allclose(model.word_margins(seen[1]), x @ w[:-1] + w[-1], atol=1e-3)


def test_scores_are_those_of_the_worst_word(spark):
    """Word by word: long words in parts, spaced letters, repeated rows, empty and null texts, clashing columns."""
    rows = [(i, f"you {'vile' if i % 3 == 0 else 'kind'} person {i}", 0) for i in range(80)]
    labels = [(i, int(i % 3 == 0)) for i in range(80)]
    model = fit_toxicity([t for _, t, _ in rows], [y for _, y in labels])
    texts = ["", None, "v i l e person", "vi-le!", "x" * 130 + "vile" + "y" * 90, "kind", "VILE kind", "\n\t"]

    def worst(text):
        best = None
        for w in toxicity.words_of(text):
            for part in toxicity.parts_of(w):
                m = float(model.word_margins([part])[0])
                best = m if best is None else max(best, m)
        return float(toxicity.sigmoid(model.slope * (model.bias if best is None else best) + model.offset))

    assert np.allclose(model.scores(texts), [worst(t) for t in texts], atol=1e-6)
    docs = spark.createDataFrame([(900 + i, t, "s") for i, t in enumerate(texts)] + [(902, texts[2], "s")] + rows[:0], "doc_id long, text string, score string")
    held = spark.createDataFrame([(i, t, "z") for i, t, _ in rows], "doc_id long, text string, score string")
    scored = score_toxicity(docs.unionByName(held), spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = [r for r in scored.collect() if r["doc_id"] >= 900]
    assert len(found) == len(texts) + 1 and len({r["score"] for r in found if r["doc_id"] == 902}) == 1
    empty = score_toxicity(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert empty.collect() == []


def plain_features(text):
    codes = [c if 97 <= c <= 122 or c >= 128 else 32 for c in f" {text} ".lower().encode()]
    counts = np.zeros(2 << language_id.BITS)
    for i in range(len(codes) - 1):
        if codes[i : i + 2] != [32, 32]:
            counts[(codes[i] << 8 | codes[i + 1]) * 2654435761 % 2**32 >> (32 - language_id.BITS)] += 1
    for i in range(len(codes) - 2):
        if codes[i : i + 3] != [32, 32, 32]:
            counts[(1 << language_id.BITS) + ((codes[i] << 16 | codes[i + 1] << 8 | codes[i + 2]) * 2246822519 % 2**32 >> (32 - language_id.BITS))] += 1
    return np.sqrt(counts / counts.sum()) if counts.sum() else counts


def plain_winner(duels, x):
    """Most votes among pairs, then the larger sum of margins, one pair after the other."""
    names, votes, sums = duels.classes, dict.fromkeys(duels.classes, 0), dict.fromkeys(duels.classes, 0.0)
    for (a, b), w in zip(duels.pairs, duels.weights, strict=True):
        m = sum(float(p) * float(q) for p, q in zip(w[:-1], x, strict=True) if q) + float(w[-1])
        votes[names[a if m >= 0 else b]] += 1
        sums[names[a]] += m
        sums[names[b]] -= m
    return max(names, key=lambda n: (votes[n], sums[n]))


def test_languages_against_plain_votes(spark):
    draw = random.Random(12)
    syllables = {"en": "the an er ing th".split(), "de": "ein der sch ung ich".split(), "fr": "eau que ion les".split(), "es": "cion que os la".split(), "pt": "cao que os nh".split(), "xx": "zz qx kw vy".split()}
    text = lambda lang, n: " ".join("".join(draw.choice(syllables[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(n))
    cases = [(text(lang, 30), lang) for lang in syllables for _ in range(20)]
    model = language_id.fit_language_model([t for t, _ in cases], [lang for _, lang in cases])
    for sample in [text(lang, n) for lang in syllables for n in (1, 5, 60)] + ["123 a", "ÀÉ ñ", "x  y\n z"]:
        x = plain_features(sample)
        blank = [(0x2020 * 2654435761 & 0xFFFFFFFF) >> (32 - language_id.BITS), (1 << language_id.BITS) + ((0x202020 * 2246822519 & 0xFFFFFFFF) >> (32 - language_id.BITS))]
        ours = language_id.features(sample)
        told = np.ones(len(x), dtype=bool)
        told[blank] = False
        assert np.allclose(ours[told] / np.linalg.norm(ours[told]), x[told] / np.linalg.norm(x[told]))
        lang, score = model.predict(sample)
        family = plain_winner(model.families, ours.astype(np.float32))
        assert lang == plain_winner(model.within[family], ours.astype(np.float32)) and 0 <= score <= 1
    long = text("de", 40) + " " + text("de", 4000) * 60
    assert len(long.encode()) > 1 << 20
    assert np.allclose(language_id.features(long), _whole(long))
    rows = [(i, t, lang, 1.0) for i, (t, lang) in enumerate(cases)] + [(3, cases[3][0], cases[3][1], 2.0)] * 2 + [(500, None, "en", 0.0), (501, " 12 ", "de", 0.0), (None, long, None, 0.0)]
    out = identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")).collect()
    assert len(out) == len(rows) and len({(r["lang_pred"], r["score"]) for r in out if r["doc_id"] == 3}) == 1
    assert {r["doc_id"]: r["lang_pred"] for r in out if r["doc_id"] in (500, 501, None)} == {500: "und", 501: "und", None: "de"}
    assert identify_languages(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def _whole(text):
    """Features of a text taken as one piece."""
    chunk, language_id.CHUNK = language_id.CHUNK, 1 << 30
    try:
        return language_id.features(text)
    finally:
        language_id.CHUNK = chunk


def test_long_items_and_texts(spark):
    """Items of thousands of words in texts of several pieces, whole, edited and cut short; repeated rows; bounded memory."""
    draw = random.Random(31)
    text = lambda n: [f"w{draw.randrange(4000)}" for _ in range(n)]
    item, other = text(3000), text(40)
    edited = [w if draw.random() > 0.1 else "edited" for w in item]
    rows = [(1, " ".join(text(5000) + item + text(100))), (2, " ".join(text(50) + edited)), (3, " ".join(item[:1500] + text(1500))), (4, " ".join(text(9000) + other + text(9000))), (4, " ".join(text(10) + other)), (5, None), (6, "")]
    found = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item)), (8, " ".join(other)), (9, None)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 7), (2, 7), (4, 8)}
    held = {(r["doc_id"], r["item_id"]): r for r in found}
    assert held[1, 7]["distance"] == 0 and (held[1, 7]["start"], held[1, 7]["end"]) == (5000, 8000)
    assert held[2, 7]["distance"] == edited.count("edited")


def test_blocks_of_a_long_text_overlap(monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK_CHARS", 120)
    words = [f"w{i}" for i in range(500)]
    seen = set()
    for first, block in decontaminate._blocks(" ".join(words), 9):
        assert block == words[first : first + len(block)]
        seen |= {first + i for i in range(len(block) - 9)}
    assert seen >= set(range(500 - 9))
