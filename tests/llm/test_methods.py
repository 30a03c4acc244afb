"""The methods inside the operators against independent computations, and rows that share an id or have none."""

import math
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from test_operators import LOW, TEXTS, words

from corvane.llm.components import components
from corvane.llm.decontam import contaminated
from corvane.llm.exact_dedup import exact_duplicates
from corvane.llm.language_id import ByteGru, detect_languages
from corvane.llm.lm_score import score_texts
from corvane.llm.mixing import mix_sources, source_targets, tilt
from corvane.llm.phrase_dedup import remove_repeats
from corvane.llm.simhash import link_fingerprints, near_duplicates
from corvane.llm.token_count import LONG_SYMBOLS, WordBpe, count_tokens
from corvane.llm.toxicity import ToxicField, score_toxicity
from corvane.llm.url_filter import judge_urls


def test_long_chains_and_hubs_are_one_component(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5000, 5000)]
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    sizes = Counter(r["root"] for r in found)
    assert sizes == {0: 301, 1000: 40}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("shard", [1024, 20, 3])
def test_crowded_keys_lose_no_link(spark, shard):
    rng = random.Random(1)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for _ in range(3):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    center = rng.getrandbits(64)
    values |= {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 7))) for _ in range(150)}
    values = sorted(values)
    part = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if a < b and (a ^ b).bit_count() <= 4 and part[a] != part[b]:
                    part[a] = part[b] = min(part[a], part[b])
                    changed = True
    signed = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    got = Counter(r["root"] for r in components(link_fingerprints(signed, 4, shard)).collect())
    want = Counter(n for n in Counter(part.values()).values() if n > 1)
    assert Counter(got.values()) == want


def test_dual_meets_its_constraints(spark):
    """Against a solution by nested bisection of both multipliers."""
    rng = random.Random(5)
    cells = [(s, 2 ** k, math.log2(2 ** k) - 5.0, rng.randint(1, 30)) for s in "abcd" for k in range(1, 9)]
    size = Counter()
    for s, w, _, n in cells:
        size[s] += w * n
    targets = {"a": 0.4 * size["a"], "b": 1.7 * size["b"], "c": 2.9 * size["c"], "d": 3.0 * size["d"]}
    found = tilt(spark.createDataFrame(cells, "src string, size long, lean double, n long"),
                 spark.createDataFrame(list(targets.items()), "src string, target double"), 3.0, 0.5)
    got = {r["src"]: (r["a"], r["b"]) for r in found.collect()}
    assert set(got) == set(targets)
    for s, t in targets.items():
        own = [(w * n, g) for src, w, g, n in cells if src == s]
        rate = lambda a, b, g: min(3.0, math.exp(min(a + b * g, 700)))
        a, b = got[s]
        assert math.isclose(sum(m * rate(a, b, g) for m, g in own), t, rel_tol=1e-6)
        if s == "d":
            continue

        def best_a(b):
            lo, hi = -60.0, 60.0
            for _ in range(100):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if sum(m * rate(mid, b, g) for m, g in own) < t else (lo, mid)
            return lo

        lo, hi = -20.0, 20.0
        for _ in range(80):
            mid = (lo + hi) / 2
            at = best_a(mid)
            lo, hi = (mid, hi) if sum(m * g * rate(at, mid, g) for m, g in own) + 0.5 * t * mid < 0 else (lo, mid)
        assert math.isclose(b, lo, rel_tol=1e-5, abs_tol=1e-7) and math.isclose(a, best_a(lo), rel_tol=1e-5, abs_tol=1e-6)
        assert abs(b) > 1e-3


def test_targets_by_source(spark):
    def plain(sizes):
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        total, held = sum(sizes.values()), {}
        while True:
            free = [s for s in names if s not in held]
            left = total - sum(held.values())
            share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            over = [s for s in free if share[s] > 3 * sizes[s]]
            if not over:
                return held | share
            held |= {s: 3.0 * sizes[s] for s in over}

    for sizes in ({"a": 10, "b": 500, None: 30}, {"x": 7}, {"é": 1, "z": 1, "a": 9000, "b": 4, None: 2}):
        rows = spark.createDataFrame([("=" + k if k else "", k, v) for k, v in sizes.items()], "src string, source string, source_size long")
        got = {r["source"]: r["target"] for r in source_targets(rows).collect()}
        want = plain(sizes)
        assert set(got) == set(want) and all(math.isclose(got[s], want[s], rel_tol=1e-9) for s in want)


def test_repeats_are_found_by_the_automaton(spark, monkeypatch):
    from corvane.llm import phrase_dedup

    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(1, text), (2, "x " + text)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in remove_repeats(rows).collect()} == {1: 0, 2: 60}
    block = phrase_dedup.Block(phrase_dedup.pa.array([text, "x " + text]))
    hits, which = phrase_dedup.phrase_hits(block, np.array([3, 10]))
    assert sorted(zip(hits.tolist(), which.tolist(), strict=True)) == [(3, 0), (10, 1), (64, 0), (71, 1)]
    nothing = lambda *a: (np.zeros(0, np.int64), np.zeros(0, np.int64))
    monkeypatch.setattr(phrase_dedup, "phrase_hits", nothing)
    block = phrase_dedup.Block(phrase_dedup.pa.array([text, text]))
    assert not len(phrase_dedup.candidates(block, *phrase_dedup.phrase_hits(block, np.array([3])), 15)[0])


def test_text_ids_keep_their_order(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([("b", text), ("a", text), (None, text)], "doc_id string, text string")
    assert {r["doc_id"]: r["n_removed"] for r in remove_repeats(rows).collect()} == {"a": 0, "b": 30, None: 30}


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = ByteGru(3, hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(97, 102, (5, 4)), np.array([0, 1, 2, 1])

    def loss():
        logits, _ = net.logits(x)
        logits = logits.astype(np.float64)
        return -(logits[:, np.arange(4), y] - np.log(np.exp(logits).sum(axis=2))).mean()

    keep = {}
    logits, states = net.logits(x, keep)
    e = np.exp(logits)
    d = e / e.sum(axis=2, keepdims=True)
    d[:, np.arange(4), y] -= 1
    d /= d.shape[0] * d.shape[1]
    grads = {"Wo": states.reshape(-1, 6).T @ d.reshape(-1, 3)}
    dh = d @ net.p["Wo"].T
    net._back(x, "f", keep["f"], dh[:, :, :3], grads)
    net._back(x[::-1], "b", keep["b"], dh[::-1, :, 3:], grads)
    for name in ("Wo", "Xf", "Uf", "Xb", "Ub"):
        at = (98, 4) if name[0] == "X" else (1, 1)
        step = 1e-3
        net.p[name][at] += step
        up = loss()
        net.p[name][at] -= 2 * step
        down = loss()
        net.p[name][at] += step
        assert math.isclose((up - down) / (2 * step), grads[name][at], rel_tol=0.02, abs_tol=2e-5)


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    field = ToxicField()
    field.trans = rng.normal(0, 1, (2, 2))
    sizes = np.array([4, 1, 3])
    emission = rng.normal(0, 1, 8)
    found, _, _ = field.marginals(emission, sizes)
    at = 0
    for n in sizes:
        total, marked = 0.0, np.zeros(n)
        for tags in product((0, 1), repeat=int(n)):
            w = math.exp(sum(emission[at + i] for i in range(n) if tags[i]) + sum(field.trans[a, b] for a, b in zip(tags, tags[1:])))
            total += w
            marked += w * np.array(tags)
        assert np.allclose(found[at : at + n], marked / total)
        at += n


def test_every_code_point_is_counted_as_the_library_does():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        definition = file.read()
    lib, bpe = tokenizers.Tokenizer.from_str(definition), WordBpe(definition)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000 and c not in (9, 10, 11, 12, 13, 32)]
    tried = ["a" + chr(c) + "B" for c in points]
    rng = random.Random(3)
    tried += ["".join(rng.choices("abcdeit", k=n)) for n in (LONG_SYMBOLS - 1, LONG_SYMBOLS, LONG_SYMBOLS + 1)]
    got = bpe.word_counts(tried).tolist()
    assert got == [len(e.ids) for e in lib.encode_batch(tried, add_special_tokens=False)]


ODD = [(1, "Same words here, five of them"), (1, "Same words here, five of them"), (1, "Another text with an equal id"), (None, "Same words here, five of them"),
       (None, None), (None, ""), (2, "long " * 30_000 + "x" * 70_000), (3, "long " * 30_000 + "x" * 70_000), (4, "\u3000\u00a0 \u2028"),
       (5, "\x00\x01 ~")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "xx", f"s{k % 3}", 0, True, 0.5, "n") for k, (i, t) in enumerate(ODD)]
    kind = "doc_id long, text string, lang string, source string, held_out int, kept boolean, score double, _row string"
    return spark.createDataFrame(rows, kind)


def test_rows_with_one_id_or_none(spark, odd):
    """Every operator returns one row for each row, whatever ids and other columns there are."""
    plain = odd.drop("_row")
    bench = spark.createDataFrame([(None, "same words here five of them"), (7, "zz"), (7, "zz"), (8, "another text with")], "item_id long, text string")
    marks = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1)], "doc_id long, toxic int")
    tables = [exact_duplicates(odd), near_duplicates(odd), remove_repeats(odd), count_tokens(odd), mix_sources(odd), detect_languages(odd),
              score_toxicity(odd, marks), score_texts(plain), contaminated(plain, bench)]
    for table in tables:
        assert Counter(r["doc_id"] for r in table.collect()) == Counter(i for i, _ in ODD)
    hit = Counter((r["doc_id"], r["n_hit"], r["n_items"]) for r in tables[-1].collect() if r["contaminated"])
    assert hit == {(1, 6, 0): 2, (None, 6, 0): 1, (1, 3, 1): 1}
    assert Counter(r["n_words"] for r in tables[-1].collect() if r["doc_id"] == 1) == {6: 3}
    groups = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in tables[0].collect()}
    assert {(1, 1, 3), (None, 1, 3), (2, 3, 2), (None, None, 2)} <= groups
    urls = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c"), (None, "x" * 200_000)], "page_id long, url string")
    assert judge_urls(urls).count() == 3


def brute_pipeline(rows, bench):
    """Rows kept by each stage after language ID: (place in the file) lists."""
    def prints(t):
        import xxhash

        w = words((t or "").translate(LOW))
        grams = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    best = {}
    for k, (i, t) in enumerate(rows):
        mark = (i is not None, i if i is not None else 0, k)
        best[t or ""] = max(best.get(t or "", mark), mark)
    rows = [r for k, r in enumerate(rows) if best[r[1] or ""][2] == k]
    exact = list(rows)
    fps = [prints(t) for _, t in rows]
    part = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 4 and part[a] != part[b]:
                    part[a] = part[b] = min(part[a], part[b])
                    changed = True
    lead = {}
    for k, (i, _) in enumerate(rows):
        mark = (i is None, i if i is not None else 0, k)
        lead[part[k]] = min(lead.get(part[k], mark), mark)
    rows = [r for k, r in enumerate(rows) if lead[part[k]][2] == k]
    near = list(rows)
    windows = set()
    for t in bench:
        w = split(t)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    lengths = {len(w) for w in windows}
    hit = lambda t: any(tuple(w[k : k + n]) in windows for w in [split(t)] for n in lengths for k in range(len(w) - n + 1))
    return exact, near, [r for r in rows if not hit(r[1])]


def test_pipeline_rows(spark, tmp_path):
    """Every stage's rows against brute force: unique texts under a repeated id stay, near copies and items go."""
    import corpus_pipeline

    texts = [t for t in TEXTS if t and words(t) and re.search(r"[^\W\d_]", t)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(0, texts[1]), (0, "only this row has these few words and no other"), (0, texts[0]), (None, texts[2]), (None, texts[2]),
             (None, "a text without an id that nothing else is like at all"), (900, None), (901, " 12 ")]
    item = " ".join(words(texts[4])[3:18]) if len(words(texts[4])) > 20 else texts[4]
    bench = [item, "only in the benchmark", None]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, None, f"s{k % 2}", 0) for k, (i, t) in enumerate(rows)], kind).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    exact, near, clean = brute_pipeline(rows[:-2], bench)
    assert len(rows) - 2 > len(exact) > len(near) > len(clean)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = [rows[:-2], exact, near, clean]
    for (name, stage), kept in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == Counter(kept), name
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.columns == [*docs.columns, "copy"]
    out = Counter((r["doc_id"], r["text"]) for r in final.collect())
    assert set(out) <= set(clean) and max(out.values()) <= 3
    assert abs(sum(n * len(words(t)) for (_, t), n in out.items()) - sum(len(words(t)) for _, t in clean)) <= 40
    assert Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == out


def test_chunks_do_not_depend_on_slices(monkeypatch):
    from corvane.llm import exact_dedup

    data = random.Random(2).randbytes(9 << 20)
    whole = exact_dedup.chunks_of(data)
    assert b"".join(whole) == data and max(map(len, whole)) <= exact_dedup.MAX_CHUNK
    monkeypatch.setattr(exact_dedup, "SLICE_BYTES", 1 << 20)
    assert exact_dedup.chunks_of(data) == whole
    assert max(map(len, exact_dedup.chunks_of(b"a" * 500_000))) <= exact_dedup.MAX_CHUNK
