"""Operators against brute force on a small fixture with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm.decontam import contaminated
from corvane.llm.exact_dedup import chunks_of, exact_duplicates
from corvane.llm.language_id import detect_languages
from corvane.llm.lm_score import score_texts
from corvane.llm.mixing import mix_sources
from corvane.llm.phrase_dedup import remove_repeats
from corvane.llm.simhash import BkTree, near_duplicates
from corvane.llm.token_count import WordBpe, count_tokens
from corvane.llm.toxicity import score_toxicity
from corvane.llm.url_filter import judge_urls

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, word string, fp long, count long, "
          "bucket int, n int, c long")  # fmt: skip
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


def make_texts():
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefghé", k=rng.randint(2, 7))) for _ in range(300)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 120))) for _ in range(40)]
    shared = " ".join(rng.choices(vocab, k=45))
    texts = base + [f"{base[i]}\n{shared}  {base[i + 1]}" for i in range(8)]
    texts += base[:6] + [base[9] + " tail", shared, "", "   \t\n", "Ünïcode ΣΑΣ İ x", "same " * 60, "a" * 5000, None, None]
    texts += [" ".join(rng.choices(vocab, k=4000))]
    texts.append(texts[-1])
    return texts


TEXTS = make_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i, t in enumerate(TEXTS):
        source = None if i % 11 == 0 else f"s{i % 4}"
        lang = None if i % 7 == 0 else ("xx" if i % 2 else "yy")
        rows.append((i, t, lang, source, len(t or ""), "w", 1, 2, 3, 4, 5))
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORDS.findall(t or "")


def by_id(df):
    found = {r["doc_id"]: r for r in df.collect()}
    assert set(found) == set(range(len(TEXTS)))
    return found


def test_exact_duplicates(docs, none):
    groups = {}
    for i, t in enumerate(TEXTS):
        groups.setdefault(t or "", []).append(i)
    for i, r in by_id(exact_duplicates(docs)).items():
        own = groups[TEXTS[i] or ""]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), i == max(own))
        assert r["text_sha256"] == hashlib.sha256((TEXTS[i] or "").encode()).hexdigest()
    assert exact_duplicates(none).count() == 0


def test_chunks_are_content_defined():
    data = random.Random(1).randbytes(300_000)
    chunks = chunks_of(data)
    assert b"".join(chunks) == data and len(chunks) > 10
    moved = chunks_of(b"x" * 777 + data)
    assert len(set(chunks) & set(moved)) > len(chunks) // 2


def test_near_duplicates(docs, none):
    prints = []
    for t in TEXTS:
        w = words((t or "").translate(LOW))
        grams = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0)
    part = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for a in range(len(prints)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 4 and part[a] != part[b]:
                    part[a] = part[b] = min(part[a], part[b])
                    changed = True
    for i, r in by_id(near_duplicates(docs)).items():
        assert (r["fingerprint"], r["component_id"]) == (format(prints[i], "016x"), part[i])
    assert near_duplicates(none).count() == 0


def test_bk_tree_finds_all_in_radius():
    rng = random.Random(2)
    values = [rng.getrandbits(12) for _ in range(300)]
    tree = BkTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        assert set(tree.within(v, 2)) == {x for x in values if (x ^ v).bit_count() <= 2}


@pytest.mark.parametrize("block_bytes,bucket_rows,group_blocks", [(4 << 20, 400_000, 4096), (3000, 50, 4096), (3000, 50, 3)])
def test_repeats(docs, none, block_bytes, bucket_rows, group_blocks):
    first = {}
    for i, t in enumerate(TEXTS):
        w = words(t)
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k : k + 20]), (i, k))
    for i, r in by_id(remove_repeats(docs, block_bytes=block_bytes, bucket_rows=bucket_rows, group_blocks=group_blocks)).items():
        w = words(TEXTS[i])
        gone = set()
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] != (i, k):
                gone |= set(range(k, k + 20))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (len(w), len(gone), kept)
        assert r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert remove_repeats(none).count() == 0


def test_contamination(spark, docs, none):
    plain = [i for i, t in enumerate(TEXTS) if t and len(words(t)) > 30][:3]
    items = [(1, " ".join(words(TEXTS[plain[0]])[5:30])), (2, " ".join(words(TEXTS[plain[0]])[20:29])), (10, None), (11, "!!"),
             (12, "zz " * 15), (13, " ".join(words(TEXTS[plain[1]])[:10]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    wins = {}
    for item, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(item)
    for i, r in by_id(contaminated(docs, bench)).items():
        w, hit, ids = split(TEXTS[i]), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in wins}:
                if (own := wins.get(tuple(w[k : k + n]))) and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    ids |= own
        text = ",".join(sorted(map(str, ids)))
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(ids), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert contaminated(none, bench).count() == 0
    assert contaminated(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_mix(docs, none):
    found = by_id(mix_sources(docs))
    again = {i: r["taken"] for i, r in by_id(mix_sources(docs.repartition(5))).items()}
    assert again == {i: r["taken"] for i, r in found.items()}
    taken, target = Counter(), {}
    for i, r in found.items():
        assert r["size"] == len(words(TEXTS[i])) and 0 <= r["taken"] <= 3 * r["size"]
        source = None if i % 11 == 0 else f"s{i % 4}"
        taken[source] += r["taken"]
        target[source] = r["target"]
    assert math.isclose(sum(target.values()), sum(len(words(t)) for t in TEXTS), rel_tol=1e-9)
    for source, t in target.items():
        assert abs(taken[source] - t) <= 20
    assert mix_sources(none).count() == 0


def test_token_counts(docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    lib = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    for i, r in by_id(count_tokens(docs)).items():
        assert r["n_tokens"] == len(lib.encode(TEXTS[i] or "", add_special_tokens=False).ids)
        assert r["n_bytes"] == len((TEXTS[i] or "").encode())
    assert count_tokens(none).count() == 0
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        bpe = WordBpe(file.read())
    odd = ["<|endoftext|>x<|startoftext|>", "aaaaaaaaa", "it's", "ab" * 3000, "1234", "&&&&!!"]
    assert bpe.word_counts(odd).tolist() == [len(e.ids) for e in lib.encode_batch(odd, add_special_tokens=False)]


def test_scores(docs, none):
    low = [words((t or "").translate(LOW)) for t in TEXTS]
    train = [i for i in range(len(TEXTS)) if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for i in train for w in low[i])
    n, v = sum(c.values()) + len(train), len(c) + 1
    found = by_id(score_texts(docs))
    for i, r in found.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in low[i]) + math.log10((len(train) + 0.1) / (n + 0.1 * (v + 1)))
        assert r["train_tokens"] == n and r["n_tokens"] == len(low[i]) + 1
        assert r["n_known"] == sum(c[w] > 0 for w in low[i]) + 1
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    assert sum(r["bits_per_byte"] * r["n_bytes"] for r in found.values()) < 5 * sum(r["n_bytes"] for r in found.values())
    assert score_texts(none).count() == 0


def test_urls(spark):
    urls = ["https://A.Example.org/es/x?q", "http://example.org/en/12", "http://x.org", "http://x.org/", "ftp://b.com/fr/1#t",
            "http://b.com/de/", "no scheme casino", None, "", "http://ads-bonus.net/en", "http://badstracks.net/p",
            "http://notorg/es/", "http://x.net/porn"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(df).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("x.org", "", None, "allow") and got[3] == ("x.org", "/", "org/", "allow")
    assert got[4] == ("b.com", "/fr/1", "com/fr/", "allow") and got[5][2:] == ("com/de/", "block")
    assert got[6] == ("", "", None, "block") and got[7] == ("", "", None, "allow") == got[8]
    assert got[9][3] == "block" and got[10][3] == "allow" and got[11][3] == "allow" and got[12][3] == "block"
    assert judge_urls(df.limit(0)).count() == 0
    table = spark.createDataFrame([("Blue", "soft", 1.0), ("red", "soft", 1.2), ("foul", "strict", 1.0), ("blue", "soft", 0.1)], "term string, class string, weight double")
    from corvane.llm.url_filter import vocabulary

    colours = spark.createDataFrame([(1, "u://h/blue-red"), (2, "u://h/blue/blue"), (3, "u://h/foul"), (4, "u://h/foulred")], "page_id long, url string")
    own = {r["page_id"]: (r["verdict"], r["soft_weight"]) for r in judge_urls(colours, vocabulary(table)).collect()}
    assert own == {1: ("block", 2.2), 2: ("allow", 1.0), 3: ("block", 0.0), 4: ("allow", 0.0)}


def test_languages(spark, docs, none):
    rng = random.Random(3)
    vocab = {"aa": ["the", "of", "and", "ring", "wool"], "bb": ["der", "und", "für", "schön", "lich"]}
    rows = [(i, " ".join(rng.choices(vocab[k], k=30)), k) for i in range(120) for k in [("aa", "bb")[i % 2]]]
    rows += [(500, None, None), (501, "123 !", "aa"), (502, "", "bb")]
    got = {r["doc_id"]: r for r in detect_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    right = [got[i]["lang_pred"] == k for i, _, k in rows[:120] if got[i]["held_out"]]
    assert sum(right) / len(right) > 0.9
    assert all(got[i]["lang_pred"] == "und" for i in (500, 501, 502))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert detect_languages(none).count() == 0 and len(by_id(detect_languages(docs))) == len(TEXTS)


def test_toxicity(spark, none):
    rng = random.Random(6)
    calm = ["tree", "house", "river", "walk", "slow", "green"]
    rows, labels = [], []
    for i in range(200):
        toxic = i % 4 == 0
        text = rng.choices(calm, k=20) + (rng.choices(["Idiot!", "scum", "morons"], k=3) if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in score_toxicity(df, marks).collect()}
    assert all(got[i]["predicted"] == y for i, y in labels)
    text = dict(rows)[0]
    assert all(text[s["start"] : s["end"]].lower().strip("!") in ("idiot", "scum", "morons") for s in got[0]["spans"])
    assert got[900]["score"] == got[901]["score"] == 0
    assert {r["predicted"] for r in score_toxicity(df, marks.limit(0)).collect()} == {0}
    assert score_toxicity(none, marks).count() == 0


def test_rare_toxic_words_of_a_small_language_are_labelled():
    import numpy as np

    from corvane.llm.toxicity import fit

    rng = random.Random(8)
    calm = {"en": ["tree", "house", "river", "walk"], "de": ["baum", "haus", "fluss", "weg"]}
    rows = []
    for lang, marks, n in (("en", ["idiot", "scum"], 400), ("de", ["blödian", "schuft"], 12)):
        for i in range(4 * n):
            toxic = i % 4 == 0
            words = rng.choices(calm[lang], k=12)
            if toxic:
                words.insert(6, marks[i // 4 % 2])
            rows.append((" ".join(words), int(toxic), lang))
    field = fit(rows)
    for mark in ("idiot", "scum", "blödian", "schuft"):
        word, end = field.features(["weg", mark, "weg"])
        size = np.array([3])
        p, _, _ = field.marginals(field.emissions(word, end, size), size)
        assert p[1] >= 0.5 and p[0] < 0.5


def test_scores_use_the_counts_of_all_words(spark, monkeypatch):
    from corvane.llm import lm_score

    # Tables that say nothing stand for tables whose contexts have all run together.
    made = lm_score.table_evidence
    monkeypatch.setattr(lm_score, "table_evidence", lambda *a: tuple(0 * x for x in made(*a)))
    rng = random.Random(9)
    known, unknown = ("".join(rng.choices("abcdefgh", k=400)) for _ in range(2))
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    rows = [(i, unknown if i == held[1] else known) for i in range(60) if i not in held] + [(held[0], known), (held[1], unknown)]
    got = {r["doc_id"]: r["score"] for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]] > -20 and got[held[1]] < -100


def byte_paths(spark):
    import numpy as np

    from corvane.llm.lm_score import Paths

    return spark.sparkContext.broadcast(Paths(np.ones((256, 256), np.int64)))


def test_gates_are_fit_on_all_training_texts(spark, docs):
    import numpy as np

    from corvane.llm import lm_score
    from corvane.llm.lm_score import Gates, fit_gates, table_evidence

    paths = byte_paths(spark)
    texts = docs.select("text")
    _, others = table_evidence(texts, paths)
    sample = [TEXTS[0].encode()]
    first = Gates()
    first.learn(sample, paths.value, others, lm_score.EPOCHS)
    assert not np.allclose(fit_gates(texts, sample, paths, others), first.weights)
    assert np.allclose(fit_gates(texts.limit(0), sample, paths, others), first.weights)


def test_scores_agree_with_one_choice_at_a_time(spark, docs):
    """The mixing and its refinement, choice by choice in plain Python, from the slots of the choices."""
    import numpy as np

    from corvane.llm import lm_score
    from corvane.llm.lm_score import Choices, Gates, log_scores, table_evidence

    paths = byte_paths(spark)
    tables, _ = table_evidence(docs.select("text"), paths)
    weights = Gates().weights + np.arange(Gates().weights.size, dtype=np.float32).reshape(Gates().weights.shape) / 400
    texts = [TEXTS[0].encode(), b"", TEXTS[3].encode() * 3, "Ünï".encode()]
    found = log_scores(texts, paths.value, tables, weights)[0]
    for text, log in zip(texts, found, strict=True):
        made = Choices([text], paths.value)
        total, refine, grad, done, block = 0.0, [0.0] * 4, [0.0] * 4, 0, lm_score.FIRST_BLOCK
        for i, bit in enumerate(made.bits.tolist()):
            x = [int(tables[c][made.slots[c][i]]) / 16 for c in range(4)]
            gate = int(made.depth[i]) * 4 + (x[2] != 0) * 2 + (x[3] != 0)
            z = sum((float(weights[gate, c]) + refine[c]) * x[c] for c in range(4))
            p = 1 / (1 + math.exp(-z))
            total += math.log(p if bit else 1 - p)
            for c in range(4):
                grad[c] += (bit - p) * x[c]
            if i + 1 == done + block:
                refine = [r + lm_score.REFINE * g for r, g in zip(refine, grad, strict=True)]
                done, grad = i + 1, [0.0] * 4
                block = min(max(lm_score.FIRST_BLOCK, done), lm_score.BLOCK)
        assert math.isclose(total, log, rel_tol=1e-3, abs_tol=1e-2)


def test_tables_count_every_choice(spark, docs):
    from collections import defaultdict

    from corvane.llm.lm_score import Choices, evidence, table_evidence

    paths = byte_paths(spark)
    tables, others = table_evidence(docs.select("text"), paths)
    seen = [defaultdict(lambda: [0, 0]) for _ in range(4)]
    for t in TEXTS:
        made = Choices([(t or "").encode()], paths.value)
        for c in range(4):
            for slot, bit in zip(made.slots[c].tolist(), made.bits.tolist(), strict=True):
                seen[c][slot][bit] += 1
    for c in range(4):
        for slot, (zeros, ones) in list(seen[c].items())[:3000]:
            assert tables[c][slot] == evidence(float(zeros), float(ones))
            assert others[c][2 * slot + 1] == evidence(float(zeros), float(max(ones - 1, 0)))
        assert int((tables[c] != 0).sum()) <= len(seen[c])


def test_short_texts_are_scored_with_refined_weights(spark, docs, monkeypatch):
    from corvane.llm import lm_score
    from corvane.llm.lm_score import Gates, log_scores, table_evidence

    paths = byte_paths(spark)
    tables, _ = table_evidence(docs.select("text"), paths)
    text = [TEXTS[0][:100].encode()]
    refined = log_scores(text, paths.value, tables, Gates().weights)[0]
    monkeypatch.setattr(lm_score, "REFINE", 0.0)
    assert refined != log_scores(text, paths.value, tables, Gates().weights)[0]


def test_equal_bytes_in_equal_contexts_are_trained_on_once_with_their_number(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from corvane.llm import lm_score

    texts = [*TEXTS, "Abc abc\tabcabcabc " * 40, None] * 3
    wide, word, _ = lm_score.spelled([(t or "").encode() for t in texts])
    want = Counter(zip(wide.tolist(), word.tolist(), strict=True))
    assert sum(want.values()) == sum(len((t or "").encode()) + 1 for t in texts)
    paths = lm_score.Paths(np.ones((256, 256), np.int64))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for most, size in ((lm_score.MOST_EVENTS, lm_score.EVENT_BYTES), (300, 200)):
        monkeypatch.setattr(lm_score, "MOST_EVENTS", most)
        monkeypatch.setattr(lm_score, "EVENT_BYTES", size)
        rows = list(lm_score._events(iter([batch])))
        got, stored = Counter(), 0
        for row in rows:
            for w, b, n in zip(*(row.column(c).to_pylist() for c in ("wide", "begun", "times")), strict=True):
                parts = [lm_score._unplaned(x, k).tolist() for x, k in ((w, np.uint64), (b, np.uint32), (n, np.int64))]
                stored += len(parts[0])
                for at, k in zip(zip(*parts[:2], strict=True), parts[2], strict=True):
                    got[at] += k
        assert got == want and (stored == len(want) or most == 300)
        # The choices that training goes through, and how often each stands in the texts.
        made = lm_score.Choices([(t or "").encode() for t in texts], paths)
        paved = list(lm_score._paved(iter(rows), paths))
        assert sum(int(n.sum()) for _, n in paved) == len(made.bits)
        assert most == 300 or 2 * sum(len(p.bits) for p, _ in paved) < len(made.bits)


def test_texts_are_scored_alike_alone_and_together():
    import numpy as np

    from corvane.llm import lm_score

    paths = lm_score.Paths(np.ones((256, 256), np.int64))
    rng = np.random.default_rng(4)
    tables = rng.integers(-90, 90, (4, 1 << lm_score.TABLE_BITS)).astype(np.int8)
    weights = rng.random((lm_score.GATES, 4)).astype(np.float32) / 4
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (0, 1, 6, 7, 8, 15, 16, 17, 127, 128, 129, 600, 5000)]
    found = lm_score.log_scores(texts, paths, tables, weights)[0]
    alone = [lm_score.log_scores([t], paths, tables, weights)[0][0] for t in texts]
    assert np.allclose(found, alone, rtol=1e-5)
