"""Line dedup, SimHash, suffix dedup, BPE, decontamination and license scans against plain versions."""

import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brightwater.llm import bpe, decontamination, license_scan, line_dedup, simhash_dedup, suffix_dedup

from . import brute

LONG = "A line that many documents share, long enough to count as one."
DOCS = "doc_id long, text string, id string, row string, h string, body string, key string, fp string, word string"


def table(spark, rows):
    """Rows of (id, text), with other columns whose names an operator might use itself."""
    return spark.createDataFrame([(i, t, *["x"] * 7) for i, t in rows], DOCS)


def corpus(seed=0, n=60):
    """Random prose with copies, near copies, shared lines and edge cases."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeéñ", k=r.randint(1, 8))) for _ in range(150)]
    prose = lambda k: " ".join(r.choices(vocabulary, k=k))
    rows = [(i, "\n".join(prose(r.randint(5, 30)) for _ in range(r.randint(1, 6)))) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(5)]  # exact copies
    for i in range(8):
        w = rows[10][1].split(" ")
        w[r.randrange(len(w))] = "edited"
        rows.append((n + 10 + i, " ".join(w)))
    rows += [(n + 20 + i, f"{prose(9)}\n  {LONG.upper() if i % 2 else LONG}\t\n{prose(8)}\r\nÀ{LONG}" + ("\n" + LONG) * (i % 3)) for i in range(7)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "\n\n"), (204, "ab"), (205, "x" * 3000), (206, "x" * 2000), (207, "y" * 50), (208, "y" * 49), (None, LONG), (None, None)]
    return rows


def test_lines(spark):
    rows = corpus()
    out = line_dedup.dedup_lines(table(spark, rows)).collect()
    key = lambda r: (str(r[0]), r[1], r[2], r[3])
    assert sorted(map(key, out)) == sorted(map(key, brute.line_dedup(rows)))
    assert sum(r.n_dropped for r in out) > 5


def test_lines_of_repeated_rows(spark):
    rows = [(i, f"{LONG}\nrow {i}") for i in range(6)] + [(0, f"{LONG}\nrow 0"), (0, f"other\n{LONG}"), (5, LONG)]
    out = line_dedup.dedup_lines(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.kept_text) for r in out) == sorted((r[0], r[1]) for r in brute.line_dedup(rows))


def test_fingerprints_and_groups(spark):
    rows = corpus()
    out = simhash_dedup.simhash_groups(table(spark, rows)).collect()
    fps = {(i, t): brute.simhash(t) for i, t in rows}
    known = [(i, fps[i, t]) for i, t in rows if i is not None]
    links = [(a, b) for k, (a, x) in enumerate(known) for b, y in known[:k] if (x ^ y).bit_count() <= 3]
    root = brute.components([i for i, _ in known], links)
    assert sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in out if r.doc_id is not None) == sorted((i, f, root[i]) for i, f in known)
    assert [r.component_id for r in out if r.doc_id is None] == [None, None]


@pytest.mark.parametrize("crowd", [simhash_dedup.CROWD, 0])
def test_balls_find_every_pair_of_three_bits(spark, monkeypatch, crowd):
    """Chains of fingerprints at distances 1 to 4: components follow the links and nothing else."""
    r = random.Random(5)
    fps, i = {}, 0
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(6):
            fps[i] = x
            i += 1
            for b in r.sample(range(64), r.choice([1, 2, 3, 3, 4, 5])):
                x ^= 1 << b
    frame = spark.createDataFrame([(k, int(np.uint64(v).view(np.int64))) for k, v in fps.items()], "id long, fp long")
    monkeypatch.setattr(simhash_dedup, "with_fingerprints", lambda *a, **k: frame)
    out = {r.doc_id: r.component_id for r in simhash_dedup.simhash_groups(table(spark, []), crowd=crowd).collect()}
    links = [(a, b) for a in fps for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    assert out == brute.components(list(fps), links)


def test_long_text_in_steps():
    text = " ".join(random.Random(1).choices(["aa", "b", "ccc", "É"], k=5000))
    assert simhash_dedup.fingerprint(text, step=97) == brute.simhash(text)


def test_suffixes(spark):
    rows = corpus()
    out = suffix_dedup.remove_repeats(table(spark, rows)).collect()
    got = sorted((str(r.doc_id), r.kept, r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans]) for r in out)
    assert got == sorted((str(i), *x) for i, *x in map(tuple, ((e[0], bytearray(e[1]), *e[2:]) for e in brute.suffix_dedup(rows))))
    assert sum(r.n_removed for r in out) > 500


def test_suffixes_of_crowded_seeds_and_repeated_ids(spark, monkeypatch):
    """A passage in many different surroundings is dealt out by longer runs; equal ids never match each other."""
    monkeypatch.setattr(suffix_dedup, "LARGE_SEED", 3)
    r = random.Random(2)
    noise = lambda k: "".join(r.choices("qwertzuiop ", k=k))
    passage = noise(70)
    rows = [(i, noise(60) + passage[: 70 - i] + noise(60)) for i in range(12)] + [(3, noise(60) + passage + noise(9)), (3, noise(60) + passage + noise(9))]
    rows += [(i + 20, "z" * (40 + 9 * i) + noise(i)) for i in range(8)]
    out = suffix_dedup.remove_repeats(table(spark, rows), bundle_bytes=300).collect()
    assert sorted((r.doc_id, bytes(r.kept)) for r in out) == sorted((i, k) for i, k, *_ in brute.suffix_dedup(rows))


def test_suffixes_of_templates(spark):
    """Lines of fixed text around numbers: many different pieces share a seed, and their ends."""
    a, z = "fixed words in front of " * 5, " and as many words behind it" * 4
    rows = [(i, "\n".join(f"{a[:100]}{(i * 2000 + k) * 7919 % 10**8:08d}{z[:100]}" for k in range(2000))) for i in range(8)]
    out = {r.doc_id: (bytes(r.kept), r.n_removed) for r in suffix_dedup.remove_repeats(table(spark, rows)).collect()}
    seen: set[bytes] = set()
    for i, text in rows[:3]:
        raw = text.encode()
        own = {raw[k : k + 50] for k in range(len(raw) - 49)}
        gone = np.zeros(len(raw) + 1, int)
        for k in range(len(raw) - 49):
            if raw[k : k + 50] in seen:
                gone[k] += 1
                gone[k + 50] -= 1
        stays = np.frombuffer(raw, np.uint8)[gone.cumsum()[:-1] == 0].tobytes()
        assert out[i] == (stays, len(raw) - len(stays))
        seen |= own
    assert all(out[i][1] > 0.9 * len(t) for i, t in rows[1:])


@pytest.mark.parametrize("bundle", [1 << 22, 2000])
def test_suffixes_in_bundles_with_text_ids(spark, bundle):
    """Bundles and buckets of any size give the same; ids may be strings."""
    rows = [(None if i is None else f"d{i}", t) for i, t in corpus(7)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string"), bundle_bytes=bundle, bucket_bytes=3000).collect()
    got = sorted((str(r.doc_id), bytes(r.kept), r.n_removed) for r in out)
    assert got == sorted((str(i), k, n) for i, k, _, n, _ in brute.suffix_dedup(rows))


@pytest.mark.parametrize("size", [20, 35, 50])
def test_pieces_hold_each_window_once(size, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 333)
    r = random.Random(9)
    texts = [bytes(r.choices(b"abc ", k=k)) for k in (0, 49, 50, 51, 400, 3)] + [b"z" * 1500, b"ab" * 700]
    text, seed, start, end = suffix_dedup.pieces(texts, 50, size)
    seen, by_window = [], {}
    for i, h, a, z in zip(text.tolist(), seed.tolist(), start.tolist(), end.tolist()):
        assert 50 <= z - a < 50 + suffix_dedup.PIECE_WINDOWS and z <= len(texts[i])
        seen += [(i, p) for p in range(a, z - 49)]
        for p in range(a, z - 49):
            assert by_window.setdefault(texts[i][p : p + 50], h) == h
    assert sorted(seen) == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - 49)]


def test_run_length_index_has_matching_statistics():
    """Strings that are not in the index stream through it; what is found is what stands in a string of a smaller owner."""
    r = random.Random(3)
    strings = ["".join(r.choices("ab", k=r.randint(50, 90))).encode() for _ in range(30)]
    strings += [s[5:60] + b"c" * r.randint(0, 9) for s in strings if len(s) >= 60] + [b"abc" * 40, b"abc" * 20]
    owners = np.array([r.randrange(20) for _ in strings])
    index = suffix_dedup.RunLengthIndex(strings, owners, 50)
    assert len(index.starts) < sum(map(len, strings))
    others = [b"x" + strings[0][:55] + b"\xff" + strings[3][2:], b"cab" * 30, b"q" * 70, strings[40] + strings[1], b"short"]
    s, o = index.stream(others, np.full(len(others), 15))
    assert sorted(zip(s.tolist(), o.tolist())) == [(i, p) for i, t in enumerate(others) for p in range(len(t) - 49) if any(t[p : p + 50] in x and w < 15 for x, w in zip(strings, owners))]
    found = suffix_dedup.find_repeats(strings, owners, 50)
    for s, own, spans in zip(strings, owners, found):
        covered = set()
        for p in range(len(s) - 49):
            if any(s[p : p + 50] in t and o < own for t, o in zip(strings, owners)):
                covered |= set(range(p, p + 50))
        assert covered == {x for a, n in spans for x in range(a, a + n)}


@pytest.fixture(scope="module")
def tokenizer_json():
    return open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()


@pytest.mark.parametrize("head", [0, 800, 10**7])
def test_bpe_round_trip(spark, tokenizer_json, head):
    rows = corpus(n=20) + [(300, "It's DON'T 12 ΑΣ ὈΔΥΣΣΕΎΣ İ ﬁ Å µª º ẞ 你好 ⅷ ½ a_b --- é\x85\xa0\x1c"), (301, "<|endoftext|>x <|startoftext|><|ENDOFTEXT|>"), (302, "é" * 500), (302, "again")]
    tok = Tokenizer.from_str(tokenizer_json)
    out = bpe.encode_decode(table(spark, rows), tokenizer_json, outputs={"ids": (bpe.WHOLE["ids"][0], lambda ids, text: ids.tolist()), "decoded": bpe.WHOLE["decoded"]}, head_bytes=head).collect()
    expected = [(i, tok.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r.doc_id, r.ids) for r in out), key=key) == sorted(expected, key=key)
    assert all(r.decoded == tok.decode(r.ids, skip_special_tokens=False) for r in out)
    again = bpe.decode_ids(spark.createDataFrame([(r.ids,) for r in out] + [(None,)], "ids array<int>"), tokenizer_json).collect()
    assert all(r.decoded == (None if r.ids is None else tok.decode(r.ids, skip_special_tokens=False)) for r in again)


def test_bpe_of_unicode_blanks(spark, tokenizer_json):
    """Blanks beyond ASCII alone, doubled and at the ends; the library is the judge of ids and of the decoded text."""
    r, tok = random.Random(12), Tokenizer.from_str(tokenizer_json)
    parts = [" ", "  ", "\n", "\t", "a", "Bc", "10", "'s", "é", "e\u0301", "\u0301", "你", "<|endoftext|>", "-", *"\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2003\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"]
    rows = [(i, "".join(r.choices(parts, k=r.randint(1, 9)))) for i in range(20_000)]
    wanted = {i: x.ids for (i, _), x in zip(rows, tok.encode_batch([t for _, t in rows], add_special_tokens=False))}
    kinds = {"ids": (bpe.WHOLE["ids"][0], lambda ids, text: ids.tolist()), "decoded": bpe.WHOLE["decoded"]}
    out = bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_json, outputs=kinds, head_bytes=2000).collect()
    assert len(out) == len(rows) and [x.doc_id for x in out if list(x.ids) != wanted[x.doc_id]] == []
    texts = dict(zip(wanted, tok.decode_batch(list(wanted.values()), skip_special_tokens=False)))
    assert [x.doc_id for x in out if x.decoded != texts[x.doc_id]] == []


def test_bpe_sends_no_long_or_single_words(spark, tokenizer_json):
    """Texts without white space are words as long as documents: they stay in tables, however few they are."""
    rows = [(i, "z" * 5000 + f" common words {i}") for i in range(6)]
    words = bpe.distinct_words(spark.createDataFrame(rows, "id long, body string"), True).mapInArrow(bpe._encode_words(tokenizer_json), "word string, n long, ids binary")
    assert set(bpe._head(words, 1 << 20)[0]) == {"common", "words"} and bpe._head(words, 10)[0] == {}
    tok = Tokenizer.from_str(tokenizer_json)
    out = {r.doc_id: r.decoded for r in bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_json, outputs={"decoded": bpe.WHOLE["decoded"]}).collect()}
    assert out == {i: tok.decode(tok.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for i, t in rows}


def test_bpe_default_output(spark, tokenizer_json):
    r = bpe.encode_decode(table(spark, [(1, "Hello world")]), tokenizer_json).first()
    assert r.decoded == "hello</w> world</w>" and r.ids == Tokenizer.from_str(tokenizer_json).encode("Hello world", add_special_tokens=False).ids


def leaks(docs, items):
    """{id: items that the text holds}, each item in every window of its own."""
    out = {}
    for k, t in docs:
        words, out[k] = brute.words(t), []
        for i, q, a in items:
            item, answer = brute.words(q) + brute.words(a), set(brute.words(a))
            half, n = 16, min(5, len(item))
            while half < len(item):
                half *= 2
            for w in range(max(1, -(-len(words) // half) - 1)) if item else ():
                window = words[w * half : w * half + 2 * half]
                own = brute.shingles(item, n)
                if len(window) >= n and len(own & brute.shingles(window, n)) >= 0.8 * len(own) and len(answer & set(window)) >= 0.5 * len(answer):
                    out[k].append(i)
                    break
    return out


@pytest.mark.parametrize("index_bytes", [1 << 23, 60_000])
def test_contamination(spark, index_bytes):
    r = random.Random(4)
    vocabulary = ["w" + str(i) for i in range(80)]
    text = lambda k: " ".join(r.choices(vocabulary, k=k))
    items = [(i, text(r.randint(6, 40)) + ".", text(r.randint(1, 8))) for i in range(60)] + [(60, "Three words only", None), (61, None, ""), (62, "w1 w1 w1 w1 w1 w1 w1 w1 w1", "w1")]
    docs = []
    for i in range(120):
        _, q, a = items[r.randrange(60)]
        w = (q + " " + a).split(" ")
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        docs.append((i, f"{text(r.randint(0, 200))} {' '.join(w).upper()} {text(r.randint(0, 90))}"))
    docs += [(200, None), (201, ""), (202, "so: three, WORDS only!"), (203, "w1 " * 300), (204, text(3000) + " " + items[7][1] + " " + items[7][2])]
    frame = spark.createDataFrame(items, "item_id long, question string, answer string")
    out = decontamination.find_contamination(table(spark, docs), frame, index_bytes=index_bytes).collect()
    found, expected = {r.doc_id: r.item_ids for r in out}, leaks(docs, items)
    assert found == expected and sum(map(len, expected.values())) > 60


@pytest.mark.parametrize("index_bytes", [1 << 23, 500])
def test_a_verdict_depends_on_its_item_alone(spark, index_bytes):
    """An answer 60 words behind its question is none, whether or not a longer item is there and however many indexes there are."""
    r = random.Random(5)
    word = lambda: "w" + str(r.randrange(10_000))
    question, long = " ".join(word() for _ in range(20)), " ".join(word() for _ in range(300))
    docs = [(1, f"{question} {' '.join(word() for _ in range(60))} paris"), (2, f"{question} and paris"), (3, f"x {long} y"), (4, f"{' '.join(word() for _ in range(777))} {question} paris {long}")]
    for more, expected in (([], {1: [], 2: [1], 3: [], 4: [1]}), ([(2, long, None)], {1: [], 2: [1], 3: [2], 4: [1, 2]})):
        frame = spark.createDataFrame([(1, question, "paris"), *more], "item_id long, question string, answer string")
        out = decontamination.find_contamination(table(spark, docs), frame, index_bytes=index_bytes).collect()
        assert {x.doc_id: x.item_ids for x in out} == expected


def test_licenses_of_a_long_repeated_text(spark):
    """A text of 60,000 words of one license again and again: work grows with its length."""
    _, _, body = max(license_scan.TEMPLATES, key=lambda t: len(t[2]))
    once = len(re.findall(r"[^\W_]+", body))
    rows = [(1, (body + " ") * (60_000 // once))]
    began = time.perf_counter()
    n = license_scan.scan_licenses(table(spark, rows), license_scan.default_templates(spark)).where("containment >= 0.99").count()
    assert n >= 60_000 // once - 1 and time.perf_counter() - began < 100


def test_wand_finds_what_a_full_scan_finds():
    r = random.Random(11)
    word = lambda: "w" + str(min(int(r.expovariate(0.05)), 90))
    items = [(i, " ".join(word() for _ in range(r.randint(3, 12))), word()) for i in range(150)]
    index = decontamination.build_index(items, 5, 0.8)
    rows = []
    for p in range(300):
        some = {word() for _ in range(r.randint(1, 25))} | set((items[r.randrange(150)][1] if p % 2 else "").split())
        rows += sorted((p, index.term_of[w]) for w in some if w in index.term_of)
    passage, term = (np.array(x) for x in zip(*rows))
    full = {}
    for p, t in rows:
        for k in range(index.starts[t], index.starts[t + 1]):
            full[p, index.items[k]] = full.get((p, index.items[k]), 0) + index.impacts[k]
    found = decontamination.retrieve(index, passage, term)
    assert {(p, i): round(s, 9) for p, i, s in found} == {k: round(s, 9) for k, s in full.items() if s >= 1} and len(found) > 100
    assert len(found) == len({(p, i) for p, i, _ in found})


def test_contamination_verbatim_is_whole(spark):
    """Every item that stands word for word in a text is found wherever it stands."""
    r = random.Random(6)
    text = lambda k: " ".join("v" + str(r.randrange(400)) for _ in range(k))
    items = [(i, text(r.randint(5, 50)), text(6)) for i in range(40)]
    docs = [(i, text(p) + " " + items[i % 40][1] + " " + items[i % 40][2] + " " + text(p % 70)) for i, p in enumerate(range(0, 400, 3))]
    out = decontamination.find_contamination(table(spark, docs), spark.createDataFrame(items, "item_id long, question string, answer string")).collect()
    assert all(r.doc_id % 40 in r.item_ids for r in out)


def test_question_and_answer(spark):
    f = spark.createDataFrame([("One. Two words? Three!",), ("only one",), (None,)], "text string")
    assert [tuple(r) for r in decontamination.question_and_answer(f).select("question", "answer").collect()] == [("One. Two words?", "Three!"), ("only one", ""), ("", "")]


def tokens(text):
    return [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]


@pytest.mark.parametrize("part_bytes", [1 << 20, 9000])
def test_licenses(spark, part_bytes):
    """Whole texts and notices between other words, against plain containment in the whole text; in one scan and in several."""
    notices = {i: t for i, _, t in license_scan.TEMPLATES}
    templates = license_scan.default_templates(spark).unionByName(spark.createDataFrame([(900, "short", "two words"), (901, "none", None), (902, "none", " - ")], "template_id int, license string, text string"))
    notices[900] = "two words"
    r = random.Random(8)
    filler = lambda k: " ".join(r.choices(["the", "of", "work", "this", "is", "software", "under", "license", "qua"], k=k))
    pick = sorted(notices)
    docs = [(i, f"{filler(r.randint(0, 120))}\n{notices[pick[i % len(pick)]].upper() if i % 2 else notices[pick[i % len(pick)]]} {filler(r.randint(0, 60))}") for i in range(len(pick))]
    docs += [(1000, filler(4000)), (1001, None), (1002, ""), (1003, "MIT"), (1004, filler(2000) + " " + notices[6] + " " + filler(900)), (None, notices[1]), (0, docs[0][1])]
    out = license_scan.scan_licenses(table(spark, docs), templates, part_bytes=part_bytes).collect()
    found = {}
    for x in out:
        found.setdefault(x.doc_id, set()).add(x.template_id)
    sets = {i: brute.shingles(tokens(t), min(5, len(tokens(t)))) for i, t in notices.items()}
    expected = {d: {i for i, s in sets.items() if len(s & brute.shingles(tokens(t), min(5, len(tokens(notices[i]))))) >= 0.8 * len(s)} for d, t in docs}
    assert all(set(found.get(d, ())) <= s for d, s in expected.items())  # the whole text may hold runs of a template in several places
    assert all(pick[d] in found[d] for d in range(len(pick))) and 6 in found[1004] and 1 in found[None]
    assert sum(map(len, found.values())) >= 0.98 * sum(map(len, expected.values()))
    lengths = {(d, len(tokens(t))) for d, t in docs}
    assert all(x.first_word <= x.last_word < max(n for d, n in lengths if d == x.doc_id) and x.containment >= 0.8 for x in out)
    assert len([x for x in out if x.doc_id == 0]) == 2 * len({(x.template_id, x.first_word) for x in out if x.doc_id == 0})


def test_bands():
    assert 1 - (1 - 1 / 12) ** license_scan.bands_needed(1 / 12, 1e-6) >= 1 - 1e-6
    assert license_scan.bands_needed(1.0, 1e-6) == 1


def test_empty_tables(spark, tokenizer_json):
    none = table(spark, [])
    items = spark.createDataFrame([(1, "q q q q q q", "a")], "item_id long, question string, answer string")
    for out in (
        line_dedup.dedup_lines(none), simhash_dedup.simhash_groups(none), suffix_dedup.remove_repeats(none), bpe.encode_decode(none, tokenizer_json),
        decontamination.find_contamination(none, items), license_scan.scan_licenses(none, license_scan.default_templates(spark)),
        license_scan.scan_licenses(none, license_scan.default_templates(spark).limit(0)),
    ):
        assert out.collect() == []
    assert decontamination.find_contamination(table(spark, [(1, "x")]), items.limit(0)).first().n_items == 0
    assert F is not None
