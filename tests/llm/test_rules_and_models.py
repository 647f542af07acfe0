"""Quality rules, language identification, importance resampling and token counts against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracequery.llm import importance, language_id, packing, quality_rules, textkit, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema="doc_id long, text string, lang string, source string"):
    return spark.createDataFrame(rows, schema)


def base(text):
    """The fixed rules, plainly."""
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    again = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), n < 50 or 100 * len(again) > 50 * n


ODD = [None, "", " \n\t ", "a", "é ü\n\né ü\n", "#*$ | x\nx\nx \nx", "a b c a b c a b c", "x " * 60, "中文 字 " * 20, "one two\rthree\x0bfour\x1cfive", "w" * 5000, "line\n" * 300]


def test_fixed_rules_against_brute_force(spark):
    docs = [(i, t, "en", "s") for i, t in enumerate(ODD)] + [(5, ODD[5], "en", "s")]
    got = quality_rules.judge(frame(spark, docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r)[1:7] == base(ODD[r.doc_id]), r
        assert not (r.base_failed and r.kept)


def test_quality_on_an_empty_table_and_clashing_columns(spark):
    assert quality_rules.judge(frame(spark, [])).count() == 0
    docs = frame(spark, [(1, "word " * 30 + " ".join(map(str, range(60))), None, "s")]).withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit(7)).withColumn("band_lang", F.lit("x"))
    out = quality_rules.filter_docs(docs)
    assert out.columns == docs.columns
    assert quality_rules.judge(docs).count() == 1


def symbols(text):
    return [quality_rules._lowered(ord(c)) if ord(c) < quality_rules.SYMBOLS else 0xE000 + ord(c) % 6400 for c in text]


def plain_kneser_ney(texts):
    """Modified Kneser-Ney probabilities by definition, over document counts and tuples of symbols."""
    order = quality_rules.ORDER
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = [quality_rules.SPACE] * (order - 1) + symbols(t)
        for g in {tuple(s[i - order + 1 : i + 1]) for i in range(order - 1, len(s))}:
            counts[order][g] += 1
    for n in range(order - 1, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]] += 1
    cuts = [None] + [[0, *quality_rules.discounts(Counter(c.values()))] for c in counts[1:]]
    followers = [None] + [defaultdict(list) for _ in range(order)]
    for n in range(1, order + 1):
        for g, c in counts[n].items():
            followers[n][g[:-1]].append(c)

    def p(g):
        if not g:
            return 1 / quality_rules.SYMBOLS
        known, d, c = followers[len(g)][g[:-1]], cuts[len(g)], counts[len(g)][g]
        return max(c - d[min(c, 3)], 0) / sum(known) + sum(min(d[min(x, 3)], x) for x in known) / sum(known) * p(g[1:])

    return {g: p(g) for g in counts[order]}


LM_TEXTS = ["the cat sat on the mat. ", "Ein Käse, ein Brot; über 12 Wege!", "THE then than that there", "日本 #1 日本 😀\n", "", None, "the cat sat", "x"]


@pytest.mark.parametrize("unit_bytes", [40, quality_rules.UNIT_BYTES])
def test_language_model_against_definition(spark, monkeypatch, unit_bytes):
    monkeypatch.setattr(quality_rules, "UNIT_BYTES", unit_bytes)
    monkeypatch.setattr(quality_rules, "LOOKUP_BYTES", 1 if unit_bytes == 40 else quality_rules.LOOKUP_BYTES)
    blocks = textkit.blocks
    monkeypatch.setattr(textkit, "blocks", lambda texts, limit=unit_bytes: blocks(texts, limit))
    docs = frame(spark, [(i, t, "x", "s") for i, t in enumerate(LM_TEXTS)])
    want = plain_kneser_ney([t or "" for t in LM_TEXTS])
    units = quality_rules.write_units(docs.select("doc_id", "lang", "text").repartition(2))
    got = {}
    for r in quality_rules.probabilities(quality_rules.count_grams(units)).collect():
        got[tuple(r.gram >> 16 * j & 0xFFFF for j in reversed(range(4)))] = r.p
    assert set(got) == set(want) and all(got[g] == pytest.approx(want[g], rel=1e-9) for g in want)
    by_context = defaultdict(float)
    for g, p in got.items():
        by_context[g[:-1]] += p
    assert all(0 < p <= 1 + 1e-9 for p in by_context.values())
    for r in quality_rules.measure(units, 2).collect():
        s = [quality_rules.SPACE] * 3 + symbols(LM_TEXTS[r.doc_id] or "")
        costs = [-math.log(want[tuple(s[i - 3 : i + 1])]) for i in range(3, len(s))]
        assert r.n_chars == len(costs) and (r.log_perplexity is None) == (not costs)
        assert not costs or r.log_perplexity == pytest.approx(sum(costs) / len(costs), rel=1e-5)


def test_kept_against_bands_by_definition(spark):
    """Verdicts of the whole query from its own log perplexities, medians and quartiles taken by sorting."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = frame(spark, [(-1, "one of its own " + " ".join(f"v{i}" for i in range(60)), "only", "s"), (-2, None, None, "s"), (-3, " ".join(f"q{i}" for i in range(70)), None, "s"), (-4, " ".join(f"q{i}" for i in range(70)), "", "s")])
    got = quality_rules.verdicts(rows.union(odd)).collect()
    by = defaultdict(list)
    for r in got:
        if not r.base_failed:
            by[r.lang].append(r)
    point = lambda x, q: sorted(x)[max(0, math.ceil(q * len(x)) - 1)]
    assert None in by and "" in by
    for own in by.values():
        middle = point([r.log_perplexity for r in own], 0.5)
        assert own[0].middle == pytest.approx(middle, abs=quality_rules.STEP)
        each = [(r.log_perplexity - own[0].middle) / math.sqrt(1 / r.n_chars + 1 / quality_rules.SPREAD) for r in own]
        reach = quality_rules.WIDTH * (1 + quality_rules.FEW / math.sqrt(len(own)))
        a, b, c = (point(each, q) for q in (0.25, 0.5, 0.75))
        low, high = b - reach * max(quality_rules.LEAST, b - a), b + reach * max(quality_rules.LEAST, c - b)
        slack = 0.03 * max(1, high - low)
        for r, z in zip(own, each, strict=True):
            assert r.deviation == pytest.approx(z, abs=1e-6)
            if min(abs(z - low), abs(z - high)) > slack:
                assert r.kept == (low <= z <= high)
    assert all(not r.kept for r in got if r.base_failed) and next(r for r in got if r.doc_id == -1).kept


@pytest.mark.parametrize("letters", ["абвгдежзиклмнопрстуфхцчшыьэюя", "的一是不了人我在有他这为之大来以个中上们到说国和地也子时道出而要于就下得可你年生"])
def test_noise_in_other_scripts_is_rejected(spark, letters):
    import random

    rng = random.Random(12)
    lexicon = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(150)]
    clean = [(i, " ".join(rng.choice(lexicon) for _ in range(rng.randint(60, 300))) + ".", "xx", "s") for i in range(120)]
    noise = [(1000 + i, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(120)) + ".", "xx", "s") for i in range(5)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(frame(spark, clean + noise)).collect()}
    assert not any(got[d] for d, *_ in noise) and sum(got[d] for d, *_ in clean) >= 118


def test_bands_reject_noise_and_keep_clean_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    noise = frame(spark, [(10**6 + i, " ".join(f"q{j}zx#{j * i}~~xq" for j in range(80)), "en", "s") for i in range(1, 4)])
    got = {r.doc_id: r for r in quality_rules.judge(docs.union(noise)).collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert not any(got[10**6 + i].kept for i in range(1, 4))
    clean = [d for d in good if d in got and not got[d].base_failed]
    assert sum(got[d].kept for d in clean) >= 0.99 * len(clean)


def test_bands_separate_labelled_junk_from_clean_text(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_rules.judge(spark.read.parquet(f"{sf}/documents.parquet")).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    clean, junk = ([r.kept for r in got if r.quality == q] for q in (1, 0))
    assert sum(clean) >= 0.98 * len(clean)
    assert len(junk) > 10 and sum(junk) <= 0.3 * len(junk)


def test_language_id_held_out_accuracy_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language_id.train(docs.where(~held))
    odd = frame(spark, [(-1, None, "en", "s"), (-2, "", "en", "s"), (-3, "123 !? 456", "en", "s"), (-4, "ä", None, "s"), (-5, "the of and the " * 4000, "de", "s")])
    got = {r.doc_id: r for r in language_id.identify(docs.where(held).union(odd), model).collect()}
    truth = {r.doc_id: r.lang for r in docs.where(held).collect()}
    assert all((zlib.crc32(str(d).encode()) % 5 == 0) for d in truth)
    assert np.mean([got[d].lang_pred == v for d, v in truth.items()]) > 0.97
    assert [got[d].lang_pred for d in (-1, -2, -3)] == ["und"] * 3 and got[-4].lang_pred in model.langs and got[-5].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}
    assert language_id.train(odd.where("lang is null")) is None


def test_language_id_of_odd_tables(spark):
    words = {"a": "alpha beta gamma delta", "b": "one two three four"}
    docs = [(i, " ".join([words["ab"[i % 2]]] * (1 + i % 5)), "ab"[i % 2], "s") for i in range(60)]
    model = language_id.train(frame(spark, docs).withColumn("features", F.lit("mine")).withColumn("size", F.lit(1)))
    rows = frame(spark, [(1, docs[0][1], "b", "s"), (1, docs[0][1], "b", "s"), (2, docs[1][1] + " x" * 200000, None, "s"), (None, "beta delta", "b", "s")])
    got = language_id.identify(rows.withColumn("score", F.lit(7)).withColumn("accepted", F.lit("no")), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 4 and got[0] == got[1] and by[1].lang_pred == "a" and by[None].lang_pred == "a" and by[2].lang_pred in model.langs
    assert language_id.identify(rows.where("false"), model).count() == 0 and language_id.train(rows.where("false")) is None


def test_language_scores_against_definition(spark):
    docs = [(i, ("der die das " if i % 2 else "the of and ") * (i % 7 + 1), "de" if i % 2 else "en", "s") for i in range(40)]
    model = language_id.train(frame(spark, docs), buckets=256)
    for (block,) in ([*textkit.blocks(pa.array([t]))] for t in ("the und", "das of x", "q")):
        feature, _ = language_id._features(block, 256)
        z = [sum(float(model.table[f, c]) for f in feature) / len(feature) + model.bias[c] for c in range(2)]
        e = [math.exp(x / model.temperature) for x in z]
        best, p = model.predict(block)
        assert best[0] == int(z[1] > z[0]) and p[0] == pytest.approx(max(e) / sum(e), rel=1e-6)
    text = "Abc  d\nefgh"
    (block,) = textkit.blocks(pa.array([text]))
    # Words, and 3- and 4-grams of bytes whose inner bytes lie in a word.
    n = sum(not re.search(r"\s", text[i + 1 : i + k - 1]) for k in (3, 4) for i in range(len(text) - k + 1))
    assert len(language_id._features(block, 256)[0]) == 3 + n


def test_language_sample_is_bounded(spark):
    docs = frame(spark, [(i, f"t{i}", "a" if i % 3 else "b", "s") for i in range(400)])
    got = Counter(r.lang for r in language_id.sample(docs, 20).collect())
    assert got == {"a": 20, "b": 20}
    assert Counter(r.lang for r in language_id.sample(docs, 20, most=10).collect()) == {"a": 5, "b": 5}


def test_importance_prefers_the_target_and_picks_exactly_k(spark):
    docs = [(i, "good words here " * 20 if i % 2 else "bad junk there " * 20, "en", "s") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = importance.resample(frame(spark, docs), labels, fraction=0.5).collect()
    assert sum(r.selected for r in got) == 30 and all(r.selected == bool(r.doc_id % 2) for r in got)
    odd = frame(spark, [(1, None, "en", "s"), (None, "x", "en", "s"), (1, None, "en", "s")])
    rows = importance.resample(odd, labels.where("false")).collect()
    assert len(rows) == 3 and all(r.log_importance == 0 for r in rows)
    assert importance.resample(frame(spark, []), labels).count() == 0


def test_importance_scores_against_definition(spark):
    docs = [(i, t, "en", "s") for i, t in enumerate(["a b c", "a b", "c c c d", "", "D c"])]
    labels = spark.createDataFrame([(0, 1), (2, 0), (4, 1)], "doc_id long, quality int")
    ratios = importance.log_ratios(frame(spark, docs), labels, 64)

    def grams(t):
        return [int(x) for b in textkit.blocks(pa.array([t])) for x in importance._features(b, 64)[0]]

    raw, target = Counter(g for _, t, *_ in docs for g in grams(t)), Counter(g for i in (0, 4) for g in grams(docs[i][1]))
    for b in range(64):
        want = math.log((target[b] + 1) / (sum(target.values()) + 64)) - math.log((raw[b] + 1) / (sum(raw.values()) + 64))
        assert ratios[b] == pytest.approx(want)
    for r in importance.score(frame(spark, docs), ratios).collect():
        assert r.log_importance == pytest.approx(sum(ratios[g] for g in grams(docs[r.doc_id][1])))


def test_importance_selection_against_sorting(spark):
    """The whole query's choice: the k largest keys, all of those equal to the last."""
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(rng.choice(["a", "b", "c", "d"], rng.integers(0, 30))), "en", "s") for i in range(150)]
    docs += [docs[3]] * 20 + [(500, "word " * 100000, "en", "s")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int")
    table = frame(spark, docs).withColumn("gumbel_key", F.lit("x")).withColumn("row_hash", F.lit(1)).withColumn("selected", F.lit(9))
    got = importance.resample(table, labels).collect()
    k = round(30 / 90 * len(docs))
    keys = sorted((r.gumbel_key for r in got), reverse=True)
    assert len(got) == len(docs) and all(r.selected == (r.gumbel_key >= keys[k - 1]) for r in got)
    same = [r for r in got if r.doc_id == 3]
    assert len(same) == 21 and len({(r.gumbel_key, r.selected) for r in same}) == 1


@pytest.mark.parametrize("k", [1, 7, 500, 999, 1000, 2000])
def test_kth_largest(spark, k):
    rng = np.random.default_rng(k)
    values = [*rng.normal(size=900).tolist(), *[0.25] * 100]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert importance.kth_largest(df, "v", k) == sorted(values, reverse=True)[min(k, 1000) - 1]


TEXTS = [None, "", "one line", "a\n\nb\n", "\n\n x\ny \n", "naïve café\nübung\n\n\nend", "word" * 3000 + "\n" + "中" * 50, "\n", "<|endoftext|> 's\n't"]


@pytest.mark.parametrize("rule", ["start", "end", "most"])
def test_token_counts_against_brute_force(spark, rule):
    P = pytest.importorskip("public_tokenizers")
    encoder = token_counts.ByteEncoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = defaultdict(list)
    docs = [(i, t, "x", "s") for i, t in enumerate(TEXTS)]
    for r in token_counts.count(frame(spark, docs), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, rule).orderBy("doc_id", "section").collect():
        got[r.doc_id].append(r)
    for i, t in enumerate(TEXTS):
        t = t or ""
        assert "".join(t[r.start_char : r.end_char] for r in got[i]) == t
        raw, at, want = t.encode(), 0, Counter()
        bounds = [len(t[: r.end_char].encode()) for r in got[i]]
        for token in encoder.encoding.encode_ordinary(t):
            size = len(encoder.encoding.decode_single_token_bytes(token))
            home = [next(k for k, b in enumerate(bounds) if j < b) for j in range(at, at + size)]
            want[home[0] if rule == "start" else home[-1] if rule == "end" else max(sorted(set(home)), key=home.count)] += 1
            at += size
        assert at == len(raw) and [r.n_tokens for r in got[i]] == [want[k] for k in range(len(got[i]))]
        assert sum(r.n_tokens for r in got[i]) == got[i][0].doc_tokens
        assert all(WORD.search(t[r.start_char : r.end_char]) for r in got[i]) or len(got[i]) == 1
    with pytest.raises(ValueError):
        token_counts.count(frame(spark, docs), "", "", "other")


def packed(spark, docs, **options):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = [[*t.encode(text or "", add_special_tokens=False).ids, 1] for _, text, *_ in docs]
    return packing.pack(frame(spark, docs), P.path("word_bpe_49k.json"), **options).collect(), ids


def check_pieces(pieces, docs, ids, width=packing.WIDTH):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert len(by_doc) == len(docs)
    for (d, *_), own in zip(docs, ids, strict=True):
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(own)
            assert p.ids_crc32 == zlib.crc32(np.array(own[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(own)
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == width or at & (at - 1) == 0 and at < width
    assert sorted(by_seq) == list(range(len(by_seq)))
    return by_seq


def test_packing_round_trip_and_mixture(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    docs = [tuple(r) for r in rows] + [(-1, None, None, None), (-2, "", "x", ""), (-3, "<|endoftext|> don't É́ 中", "x", "rare")]
    pieces, ids = packed(spark, docs)
    by_seq = check_pieces(pieces, docs, ids)
    total, share = sum(map(len, ids)), Counter()
    for (_, _, _, s), own in zip(docs, ids, strict=True):
        share[s or ""] += len(own)
    for s in by_seq.values():
        if sum(p.length for p in s) == packing.WIDTH:
            mine = Counter()
            for p in s:
                mine[p.source] += p.length
            for source, n in share.items():
                if n * packing.WIDTH >= 50 * total:
                    assert abs(mine[source] - packing.WIDTH * n / total) <= 0.02 * packing.WIDTH


@pytest.mark.parametrize("slice_tokens", [500, packing.SLICE_TOKENS])
def test_packing_mixes_small_sources_and_honours_their_targets(spark, monkeypatch, slice_tokens):
    monkeypatch.setattr(packing, "SLICE_TOKENS", slice_tokens)
    small = [(s * 10 + d, "alpha beta gamma " * 5, "x", f"s{s:02}") for s in range(60) for d in range(8 if s < 30 else 1)]
    docs = [*small, *((1000 + i, "delta alpha " * 40, "x", "big") for i in range(60))]
    pieces, ids = packed(spark, docs, width=64)
    check_pieces(pieces, docs, ids, 64)
    n, each = max(p.sequence_id for p in pieces) + 1, len(ids[0])
    for quarter in range(1, 4):
        got, singles = Counter(), 0
        for p in pieces:
            if p.sequence_id < n * quarter // 4:
                got[p.source] += p.length
        for s in range(30):
            assert abs(got[f"s{s:02}"] - 8 * each * quarter / 4) <= 1.5 * each
        singles = sum(got[f"s{s:02}"] for s in range(30, 60))
        assert abs(singles - 30 * each * quarter / 4) <= 8 * each
    pieces, ids = packed(spark, docs, width=64, targets={"s05": 0.25})
    by_seq = check_pieces(pieces, docs, ids, 64)
    for s in range(8 * each // 16 - 1):
        assert 10 <= sum(p.length for p in by_seq[s] if p.source == "s05") <= 16
    pieces, ids = packed(spark, docs, width=64, targets={"s05": 0.01})
    check_pieces(pieces, docs, ids, 64)
    mine = [p for p in pieces if p.source == "s05"]
    for k in (50, 100):
        assert abs(sum(p.length for p in mine if p.sequence_id < k) - 0.64 * k) <= 1
    for bad in ({"s05": -0.1}, {"s05": 0.7, "big": 0.4}):
        with pytest.raises(ValueError):
            packed(spark, docs, width=64, targets=bad)


def test_packing_of_repeated_rows_long_texts_and_clashing_columns(spark):
    P = pytest.importorskip("public_tokenizers")
    rows = [(1, "same text", "x", "a"), (1, "same text", "x", "a"), (2, "long " * 60000, "x", "a"), (None, "no id", "x", None)]
    docs = frame(spark, rows).withColumns({c: F.lit("mine") for c in ("part", "queue", "base", "before", "chunk", "ids", "n_tokens")})
    got = packing.pack(docs, P.path("word_bpe_49k.json"), width=256).collect()
    sizes, by_seq = Counter(), defaultdict(list)
    for p in got:
        sizes[p.doc_id] += p.length
        by_seq[p.sequence_id].append((p.offset, p.length))
    first = next(p for p in got if p.doc_id == 1)
    assert sizes[1] == 2 * first.doc_tokens and sizes[2] == 60001 and sizes[None] == next(p for p in got if p.doc_id is None).doc_tokens
    for pieces in by_seq.values():
        upto = 0
        for offset, length in sorted(pieces):
            assert offset == upto
            upto += length


def test_token_counts_of_odd_tables(spark):
    P = pytest.importorskip("public_tokenizers")
    count = lambda df: token_counts.count(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    rows = [(1, "a b\n\nc", "x", "s"), (1, "a b\n\nc", "x", "s"), (2, "word " * 100000, "x", "s"), (None, "z", "x", "s")]
    docs = frame(spark, rows).withColumns({c: F.lit("mine") for c in ("section", "n_tokens", "doc_tokens", "start_char")})
    got = count(docs)
    assert sum(r.doc_id == 1 for r in got) == 2 * len({r.section for r in got if r.doc_id == 1}) and sum(r.n_tokens for r in got if r.doc_id == 2) == 100001
    assert any(r.doc_id is None for r in got) and count(docs.where("false")) == []


def test_packing_gives_unnamed_sources_the_rest(spark):
    docs = [(i, "alpha beta gamma " * 50, "x", "abc"[i % 3]) for i in range(60)]
    pieces, ids = packed(spark, docs, width=64, targets={"a": 0.75})
    by_seq = check_pieces(pieces, docs, ids, 64)
    for s in range(10):
        got = Counter()
        for p in by_seq[s]:
            got[p.source] += p.length
        assert got == {"a": 48, "b": 8, "c": 8}
    pieces, ids = packed(spark, docs, width=64, targets={"a": 1.0, "absent": 0.0})
    by_seq = check_pieces(pieces, docs, ids, 64)
    n = sum(len(x) for x, d in zip(ids, docs, strict=True) if d[3] == "a")
    assert all(p.source == "a" for s in range(n // 64) for p in by_seq[s]) and max(p.sequence_id for p in pieces if p.source == "a") <= n // 64
    # Groups of parts are placed as all at once.
    assert packing._groups([(0, 300_000), (1, 100_000), (2, 1), (3, 500_000)]) == [(0, 1), (2, 2), (3, 3)]


@pytest.mark.parametrize("seed", range(4))
def test_schedule_against_plain_counting(seed):
    rng = np.random.default_rng(seed)
    for _ in range(30):
        width, k = int(rng.choice([16, 64, 256])), int(rng.integers(1, 6))
        totals = [int(x) for x in rng.integers(0, 3000, k)]
        weights = rng.random(k) ** 4
        weights[rng.random(k) < 0.2] = 0
        if sum((weights > 0) & (weights / max(weights.sum(), 1e-9) * width < 2)) > width // 4:
            continue
        plan = packing.Schedule(totals, list(weights), width)
        n = plan.n_sequences
        at = [plan.place(np.full(n + 1, q), np.arange(n + 1)) for q in range(k)]
        given, offset = np.array([a for a, _ in at]), np.array([b for _, b in at])
        counts = np.diff(given, axis=1)
        assert (counts >= 0).all() and (given[:, -1] == totals).all()
        assert (counts.sum(axis=0) == np.repeat(plan.sizes[:, 1], plan.sizes[:, 0])).all()
        for m in range(n):
            upto = 0
            for o, c in sorted((offset[q, m], counts[q, m]) for q in range(k) if counts[q, m]):
                assert o == upto
                upto += c
        # While all with a weight last, each has its share but for a carried part.
        share, m = weights / weights.sum() if weights.any() else weights, 0
        while m < sum(totals) // width and all(given[q, m + 1] < totals[q] for q in range(k) if weights[q]) and weights.any():
            m += 1
            assert (abs(given[:, m] - share * width * m) <= 2 + k).all()
        for q in np.flatnonzero(totals):
            cuts = np.unique([0, *rng.integers(0, totals[q], 4), totals[q]])
            owner, lo, size, seq, off = plan.pieces(np.full(len(cuts) - 1, q), cuts[:-1], np.diff(cuts))
            start = cuts[owner] + lo
            assert (start == np.cumsum(size) - size).all() and size.sum() == totals[q]
            assert (given[q, seq] <= start).all() and (start + size <= given[q, seq + 1]).all() and (off == offset[q, seq] + start - given[q, seq]).all()


def test_schedule_of_large_queues_is_exact_and_short():
    for totals, weights in [([4 * 10**10, 10**10],) * 2, ([10**13, 10**10, 5 * 10**12],) * 2, ([10**13, 10**9], [0.9999, 0.0001]), ([10**13, 7], [1.0, 0.0])]:
        plan = packing.Schedule(totals, weights)
        assert len(plan.sizes) <= 2 * len(totals) + 12
        queue = np.arange(len(totals))
        assert plan.place(queue, np.full(len(queue), plan.n_sequences))[0].tolist() == totals
        last = np.array(totals) - 5
        owner, lo, size, seq, off = plan.pieces(queue, last, np.full(len(queue), 5))
        assert size.sum() == 5 * len(queue) and (off + size <= packing.WIDTH).all()
    half = plan.place(np.array([0]), np.array([10**9]))[0]
    assert half.tolist() == [10**9 * packing.WIDTH]
    for m in (1, 10**6, 4 * 10**9):
        assert abs(int(packing.Schedule([10**13, 10**9], [0.9999, 0.0001]).place(np.array([1]), np.array([m]))[0][0]) - 0.0001 * packing.WIDTH * m) <= 1 + 1e-6 * m


def test_packing_with_targets_small_sources_and_empty_table(spark):
    docs = [(i, "alpha beta gamma delta " * (40 if i % 3 else 5), "x", "big" if i % 3 else f"s{i}") for i in range(60)]
    pieces, ids = packed(spark, docs, width=64)
    check_pieces(pieces, docs, ids, 64)
    docs = [(i, "alpha beta gamma " * 50, "x", "ab"[i % 2]) for i in range(30)]
    pieces, ids = packed(spark, docs, width=64, targets={"a": 0.75, "b": 0.25})
    by_seq = check_pieces(pieces, docs, ids, 64)
    first = Counter()
    for p in by_seq[0] + by_seq[5]:
        first[p.source] += p.length
    assert first == {"a": 96, "b": 32}
    assert packed(spark, [])[0] == []


def test_unit_encoder_equals_the_tokenizer_on_odd_text():
    import random

    P = pytest.importorskip("public_tokenizers")
    coder, rng = packing.UnitEncoder(P.path("word_bpe_49k.json"), most_units=50), random.Random(3)
    parts = ["a", "B", "É", "é", "́", " ", "\xa0", "<|endoftext|>", " ", "\n", "\x0b", "\x1c", "'s", "'", "12", "ß", "İ", "Σ", "中", "‍", "😀", "ͅ", "\x00", "﻿", "ﬁ", "\r\n", "\x85", "<", "<|", "|>", "·", "ª"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    for block in textkit.blocks(pa.array(texts), 3000):
        ids, first = coder.encode(block)
        for i in range(block.n):
            assert ids[first[i] : first[i + 1]].tolist() == coder.tokenizer.encode(texts[block.lo + i], add_special_tokens=False).ids
