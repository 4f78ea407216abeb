import gc
import hashlib
import random
import re
import zlib

import pyarrow as pa
from helpers_llm import awkward, clean_rows, documents, prose

from redpen.llm import decontamination, pii, toxicity

BAD = ["grulm", "vexnor", "smodge"]


def labelled(spark, n=240):
    draw = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = prose(1000 + i, 40).split(" ")
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(BAD) + draw.choice(["", "en", "ish", ","]))
        if not toxic and i % 8 == 1:
            words.insert(draw.randrange(len(words)), "happy smodge pie")
        rows.append((10_000 + i, " ".join(words)))
        labels.append((10_000 + i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled(spark)
    disguised = [(900, prose(1, 30) + " GRULM "), (901, prose(2, 30) + " vеxn0r "), (902, "Smödge smodge, smodgen " + prose(3, 20))]
    docs = documents(spark, rows + disguised + awkward())
    table = spark.createDataFrame(labels + [(None, 1), (5000, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(docs, table)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, lexicon).collect()}
    truth = dict(labels)
    held = [i for i in truth if got[i].held_out]
    assert held and all((i_crc(i) % 4 == 2) == got[i].held_out for i in truth)
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.95 * len(held)
    assert all(got[i].predicted == 1 for i, _ in disguised)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[4].predicted == 0
    kept = [r.doc_id for r in toxicity.drop_toxic(docs, lexicon).collect()]
    assert set(kept) == {i for i, r in got.items() if r.predicted == 0}
    assert kept.count(7) == 2


def i_crc(i):
    return zlib.crc32(str(i).encode())


def test_toxicity_exceptions_and_nothing_to_learn(spark):
    lexicon = toxicity.Lexicon({" smodge ": 5.0}, (" happy smodge pie ",), ())
    automaton = lexicon.automaton()
    assert toxicity.matches(" happy smodge pie ", automaton) == []
    assert len(toxicity.matches(" happy smodge pie smodge ", automaton)) == 1
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = documents(spark, [(1, "text"), (2, None)])
    assert {r.predicted for r in toxicity.score_toxicity(docs, toxicity.learn_lexicon(docs, none)).collect()} == {0}
    assert toxicity.score_toxicity(documents(spark, []), lexicon).collect() == []


def tokens(text):
    return re.findall(r"\w+", (text or "").lower())


def leaked(rows, items):
    windows = [(w[i : i + 13], 2) for w in map(tokens, items) for i in range(len(w) - 12)]
    windows += [(w, 0) for w in map(tokens, items) if 5 <= len(w) < 13]
    out = set()
    for i, t in rows:
        own = tokens(t)
        for w, most in windows:
            for a in range(len(own) - len(w) + 1):
                if sum(x != y for x, y in zip(own[a : a + len(w)], w)) <= most:
                    out.add(i)
                    break
    return out


def test_decontamination_against_brute_force(spark):
    draw = random.Random(6)
    items = [prose(500 + i, 18, 3000) for i in range(8)] + ["five short words are here", "too short", None, "", prose(600, 13, 3000)]
    rows = awkward()[:10]
    for i in range(50):
        words = tokens(draw.choice(items[:8]))
        at, n = draw.randrange(0, 6), draw.randrange(10, 19)
        words = words[at : at + n]
        for _ in range(draw.randrange(0, 4)):
            words[draw.randrange(len(words))] = f"other{draw.randrange(9)}"
        rows.append((2000 + i, prose(i, 25, 3000) + " " + " ".join(words) + " " + prose(i + 70, 10, 3000)))
    rows += [(3000, "x Five, short words ARE here y"), (3001, "five short other are here"), (3002, items[12])]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, hash string")
    docs = documents(spark, rows)
    got = decontamination.contaminated(docs, benchmark).collect()
    want = leaked(rows, [t for t in items if t])
    assert {r.doc_id for r in got} == want and 3000 in want and 3002 in want and len(want) > 10
    kept = decontamination.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert clean_rows([(r.doc_id, r.text) for r in kept.collect()]) == clean_rows([r for r in rows if r[0] not in want])
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(docs, none).collect() == []
    assert decontamination.contaminated(documents(spark, []), benchmark).collect() == []


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base_spans(text):
    def plain(m):
        return re.sub("[^0-9]", "", m.group())

    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(plain(m)) <= 19 and luhn(plain(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(plain(m)) <= 15]
    return ",".join(f"{pii.NAMES[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_personal_data_against_brute_force(spark):
    draw = random.Random(8)
    pieces = ["a@b.c", "a.b_c%d+e-f@g-h.i.j", "@x.y", "x@y", "a@b.c_d@e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8.9", "00.1.02.255",
              "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111 5", "79927398713", "0000 0000 0000", "+1 (456) 555-2186",
              "+12", "+1234567890123456", "+49 30 123456 ", "1--2", "😀", "é", " ", "  ", "-", ".", "\n", "word", "%", "12", "@"]
    rows = [(5000 + i, "".join(draw.choice(pieces) for _ in range(draw.randrange(1, 25)))) for i in range(400)]
    rows += awkward() + [(1, "1.2.3.4 " * 300), (2, "+" * 500), (3, "1 " * 3000), (4, "a.b@" * 400)]
    got = pii.report(documents(spark, rows)).collect()
    for kind in range(4):
        assert sum(r[1 + kind] for r in got) > 0
    told = clean_rows([(r.doc_id, r.base_sha256) for r in got])
    assert told == clean_rows([(i, hashlib.sha256(base_spans(t or "").encode()).hexdigest()) for i, t in rows])
    plain = {(r.doc_id, r.base_sha256): ",".join(s for s in r.spans.split(",") if not s.startswith("term")) for r in got}
    for i, t in rows:
        spans = base_spans(t or "")
        assert plain[i, hashlib.sha256(spans.encode()).hexdigest()] == spans


def test_disclosing_terms_are_found_and_generalised(spark):
    rows = [(i, f"{prose(i, 15)} Zorblax manages zor@corp.example here {prose(40 + i, 15)}") for i in range(6)]
    rows += [(50 + i, prose(i, 200)) for i in range(40)] + [(100, None), (101, "nothing"), (7, rows[0][1])]
    docs = documents(spark, rows)
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    for i in range(6):
        text = rows[i][1]
        assert f"term:{text.index('Zorblax')}:{text.index('Zorblax') + 7}" in spans[i].split(",")
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert "<TERM>" in texts[0] and "<EMAIL>" in texts[0] and "zor@" not in texts[0] and "Zorblax" not in texts[0]
    assert texts[50] == rows[6][1] and texts[100] is None and texts[101] == "nothing" and len(texts) == len({i for i, _ in rows})
    assert pii.report(documents(spark, [])).collect() == []


def test_disclosing_terms_far_from_the_value(spark):
    far = " ".join(f"filler{chr(97 + i % 26)} text" for i in range(60))
    rows = [(1, f"Report by Quorvane {far} write to qv@corp.example today")]
    rows += [(10 + i, f"Zorblax began. {far} Zorblax has zor@corp.example now {prose(i, 20)}") for i in range(6)]
    rows += [(30, f"{far} Zorblax was seen {far}"), (31, f"{far} nothing here")]
    rows += [(100 + i, f"{far} now today write has began was seen report {i}") for i in range(40)]
    texts = {r.doc_id: r.text for r in pii.sanitise(documents(spark, rows)).collect()}
    assert all("Zorblax" not in t for t in texts.values())
    assert texts[30] == rows[7][1].replace("Zorblax", "<TERM>") and texts[31] == rows[8][1]


def test_values_that_come_once_or_twice_get_terms(spark):
    common = " ".join(f"{w} " * 3 for w in ("please", "write", "about", "orders"))
    rows = [(i, f"{common} nothing else") for i in range(40)]
    rows += [(50, "please write Quorvane qv@corp.example about orders"), (51, "please write Mirelda mi@corp.example about orders"),
             (52, "Mirelda please write mi@corp.example orders"), (53, "Twosome please write tw@corp.example orders"), (54, "Twosome orders")]
    rows += [(55, rows[40][1])]
    texts = {r.doc_id: r.text for r in pii.sanitise(documents(spark, rows)).collect()}
    assert texts[50] == texts[55] == "please write <TERM> <EMAIL> about orders"
    assert texts[51] == "please write <TERM> <EMAIL> about orders" and texts[52] == "<TERM> please write <EMAIL> orders"
    assert texts[54] == "Twosome orders" and texts[0] == rows[0][1]


def test_terms_in_glued_tokens(spark):
    rows = [(i, f"{prose(i, 15)} owner:Zorblax/zor@corp.example {prose(40 + i, 15)}") for i in range(6)]
    rows += [(50 + i, prose(i, 200)) for i in range(40)]
    docs = documents(spark, rows)
    assert {r.term: r.n for r in pii.term_counts(docs).collect()}["zorblax"] == 6
    texts = [r.text for r in pii.sanitise(docs).collect()]
    assert not any("Zorblax" in t for t in texts)


def test_items_without_blanks_and_short_items(spark):
    sentence = "この文章は評価のために作られた例文です"
    items = [sentence, "短い問い", "Mitochondria", "北京是中国的首都，上海是最大的城市", "two tokens", "?!"]
    rows = [(1, f"前置き{sentence}後書き"), (2, "前置き" + sentence.replace("評", "別").replace("作", "他") + "後"), (3, "これは短い問いですか"),
            (4, "the mitochondria are"), (5, "我知道北京是中国的首都，上海是最大的城市吗"), (6, "has two, tokens in it"),
            (7, "この文章は別のものです"), (8, "短くない問い"), (9, "two other tokens"), (10, "?!"), (11, "北京是城市")]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontamination.contaminated(documents(spark, rows), benchmark).collect()}
    assert got == {1: [0], 2: [0], 3: [1], 4: [2], 5: [3], 6: [4]}


def test_toxicity_folds_capitals_of_other_scripts_and_styled_letters():
    for plain, other in (("джщ", "ДЖЩ"), ("σλω", "ΣΛΩ"), ("grulm", "𝐆𝐑𝐔𝐋𝐌"), ("grulm", "ⓖⓡⓤⓛⓜ"), ("\u0439", "\u0418\u0306"), ("漢字 かな", "漢字。かな")):
        assert toxicity.fold(other) == toxicity.fold(plain)
    assert toxicity.fold("한글") == " 한글 " and toxicity.fold("straße") == " strabe "
    automaton = toxicity.Lexicon({" джщ ": 5.0}, (), ()).automaton()
    assert len(toxicity.matches(toxicity.fold("и ДЖЩ!"), automaton)) == 1


def test_evidence_is_handed_on_in_bounded_parts():
    texts = [None, "", *[prose(i, 150, 3000) for i in range(300)], prose(999, 30_000, 20_000)]
    parts = list(toxicity._evidence([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])]))
    assert len(parts) > 2 and max(p.num_rows for p in parts) < toxicity.MOST_HELD + 10
    wanted = set()
    for text in texts:
        ws = toxicity.fold(text).split()
        wanted |= {(term, before) for before, w in zip(["", *ws], ws, strict=False) for term in toxicity.word_terms(w)}
    assert {(r["term"], r["before"]) for p in parts for r in p.to_pylist()} == wanted
    assert [p.num_rows for p in toxicity._evidence([])] == [0]


def test_hashes_of_tokens_stay_in_memory_for_one_task_only():
    seen = decontamination.Hashes()
    assert len(decontamination.token_hashes("Some words", seen)) == len(seen) == 2
    del seen
    gc.collect()
    assert not [o for o in gc.get_objects() if isinstance(o, decontamination.Hashes)]
