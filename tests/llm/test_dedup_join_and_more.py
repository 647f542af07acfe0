"""License scans, substring dedup, Jaccard join, chat formatting, decontamination against brute force, and the pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracequery.llm import chat_format, components, decontaminate, jaccard_join, license_scan, quality_rules, scratch, substring_dedup, textkit

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string"


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def corpus(seed, n=90):
    """Texts with copies, near copies, shared passages, repeats, odd ones, repeated rows and ids."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 3)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(15) for _ in range(4)]
    rows, made = [], []
    for i in range(n):
        kind = rng.random()
        if made and kind < 0.2:
            t = rng.choice(made)
        elif made and kind < 0.55:
            w = rng.choice(made).split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        elif kind < 0.75:
            t = text(rng.randint(0, 20)) + " " + rng.choice(passages) + "\n" + text(rng.randint(0, 20)) + "\t" + rng.choice(passages)
        else:
            t = text(rng.randint(1, 90))
        made.append(t)
        rows.append((i, t))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "One  two"), (n + 5, "x " * 400), (n + 6, "x " * 300), (3, rows[3][1]), (None, rows[5][1])]
    rng.shuffle(rows)
    return rows


def brute_dedup(rows, window=13):
    first = {}
    key = lambda d: float("inf") if d is None else d
    for d, t in rows:
        w = SPACED.findall(t or "")
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, float("inf")), key(d))
    out = []
    for d, t in rows:
        w = SPACED.findall(t or "")
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < key(d) for j in range(i, i + window)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_against_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed)
    got = substring_dedup.scan(frame(spark, rows).repartition(3)).drop("factors")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_dedup(rows)


def brute_parse(rows, window=13):
    """Greedy factors by definition: the longest match with any novel span of a smaller id, tried at every offset."""
    first, words = {}, {d: SPACED.findall(t or "") for d, t in rows}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), (d, i))
    spans = defaultdict(list)
    for d, i in sorted(first.values()):
        if spans[d] and spans[d][-1][1] == i:
            spans[d][-1][1] = i + 1
        else:
            spans[d].append([i, i + 1])
    out = {}
    for d, w in words.items():
        at, out[d] = 0, []
        while at + window <= len(w):
            best = (0, 0, 0)
            for r in spans:
                if r < d:
                    for lo, hi in spans[r]:
                        for o in range(lo, hi + window - 1):
                            n = 0
                            while at + n < len(w) and o + n < hi + window - 1 and w[at + n] == words[r][o + n]:
                                n += 1
                            best = max(best, (n, r, o))
            if best[0] >= window:
                out[d].append((at, *best))
            at += max(1, best[0]) if best[0] >= window else 1
    return out


def parsed_in_small_blocks(rows):
    """The operator's steps over text blocks of 700 bytes, three index blocks and two targets."""
    steps = [[], [], []]
    docs = np.array([substring_dedup.LAST_ID if d is None else d for d, _ in rows])
    texts, tags = pa.array([t for _, t in rows], pa.string()), np.arange(len(rows)).astype(np.uint32)
    for block in textkit.blocks(texts, 700):
        for b in substring_dedup.phrases(block, docs[block.lo : block.hi], tags[block.lo : block.hi], 13, 3, 2):
            for r in b.to_pylist():
                steps[r["kind"]].append(r)
    for key in range(3):
        if own := [r for r in steps[0] if r["key"] == key]:
            steps[2] += substring_dedup.look_up(own, 2).to_pylist()
    found = {}
    settled = []
    for key in range(2):
        own = [r for r in steps[2] if r["key"] == key]
        if told := [r for r in steps[1] if r["key"] == key]:
            settled += substring_dedup.settle_told(told, own, 2).to_pylist()
    for key in range(2):
        if own := [r for r in [*steps[2], *settled] if r["key"] == key]:
            for r in substring_dedup.runs(own).to_pylist():
                found[r["__tq_tag"]] = r["__tq_runs"]
    (block,) = textkit.blocks(texts, 10**6)
    words = textkit.Words(block)
    return words, substring_dedup.Parse(words, [found.get(i) for i in range(len(rows))], 13)


def test_substring_dedup_across_small_blocks():
    rows = corpus(3)
    words, parse = parsed_in_small_blocks(rows)
    total = np.concatenate([[0], np.cumsum(parse.removed)])
    got = [(d, int(total[words.first[i + 1]] - total[words.first[i]])) for i, (d, _) in enumerate(rows)]
    assert sorted(got, key=repr) == sorted(((d, n) for d, _, n, _ in brute_dedup(rows)), key=repr)


@pytest.mark.parametrize("seed", [3, 9])
def test_factors_are_those_of_a_greedy_parse(spark, seed):
    rows = list({d: t for d, t in corpus(seed, 60) if d is not None}.items())
    want = brute_parse(rows)
    _, parse = parsed_in_small_blocks(rows)
    got = defaultdict(list)
    for i, *factor in zip(parse.text.tolist(), parse.start.tolist(), parse.length.tolist(), parse.ref_doc.tolist(), parse.ref_start.tolist(), strict=True):
        got[rows[i][0]].append(tuple(factor))
    assert {d: got[d] for d, _ in rows} == want and sum(map(len, want.values())) > 20
    scanned = substring_dedup.scan(frame(spark, rows).repartition(3)).collect()
    assert {r.doc_id: [tuple(f) for f in r.factors] for r in scanned} == want


def test_substring_dedup_of_a_very_long_text(spark):
    rng = random.Random(4)
    w = [f"w{rng.randrange(50)}" for _ in range(60000)]
    rows = [(1, " ".join(w)), (2, "new " + " ".join(w[100:50000]) + " end"), (3, " ".join(w[5:30]))]
    got = {r.doc_id: r for r in substring_dedup.scan(frame(spark, rows)).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[3].n_removed) == (0, 49900, 25)
    assert [tuple(f) for f in got[2].factors] == [(1, 49900, 1, 100)] and [tuple(f) for f in got[3].factors] == [(0, 25, 1, 5)]


def test_substring_removal_keeps_columns_and_white_space(spark):
    p = " ".join(f"p{i}" for i in range(20))
    rows = [(1, p, 7, "a"), (2, f"start here\n{p}\nand the end", 9, "b"), (3, p, 1, "c"), (4, "", 0, "d"), (5, None, None, "e")]
    docs = frame(spark, rows, "doc_id long, text string, n_chars long, __tq string")
    got = {r.doc_id: r for r in substring_dedup.remove(docs).collect()}
    assert substring_dedup.remove(docs).columns == docs.columns
    assert sorted(got) == [1, 2, 4, 5] and got[2].text == "start here\nand the end" and got[2].n_chars == len(got[2].text) and got[1].text == p
    assert substring_dedup.remove(docs.where("false")).count() == 0


def brute_join(rows, k=5, percent=80):
    sets = []
    for _, t in rows:
        w = SPACED.findall(fold(t))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return sorted(((d, len(sets[i]), min(least[root(i)], default=None)) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("seed,size", [(4, 2000), (5, 4)])
def test_jaccard_join_against_brute_force(spark, seed, size):
    rows = corpus(seed, 120)
    got = jaccard_join.join(frame(spark, rows).repartition(3), block_size=size).drop("class_size")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_join(rows)


def test_jaccard_join_edges(spark):
    assert jaccard_join.join(frame(spark, [])).count() == 0
    only = [(1, None), (2, ""), (3, "a"), (4, "A"), (5, "b c")]
    assert sorted(tuple(r)[:3] for r in jaccard_join.join(frame(spark, only)).collect()) == [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (5, 1, 5)]
    docs = frame(spark, [*only, (3, "a"), (None, "a")]).withColumn("component_id", F.lit(9)).withColumn("cls", F.lit("x"))
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 5]


def test_keep_one_judges_rows_that_share_an_id(spark):
    a, near = " ".join(f"a{i}" for i in range(60)), " ".join(f"a{i}" for i in range(59))
    rows = [(1, a), (3, a), (3, "a text of its own that no other row has"), (1, near), (4, None), (4, None), (None, a), (5, ""), (2, near), (7, "once"), (7, "once")]
    kept = jaccard_join.keep_one(frame(spark, rows)).collect()
    own = [r.text for r in kept if r.doc_id == 1]
    assert len(own) == 1 and own[0] in (a, near)
    assert sorted(((r.doc_id or 0, r.text) for r in kept if r.doc_id != 1), key=repr) == sorted([(0, a), (3, rows[2][1]), (4, None), (5, ""), (7, "once")], key=repr)


def test_jaccard_join_of_very_long_texts(spark):
    rng = random.Random(5)
    w = [f"w{rng.randrange(10**5)}" for _ in range(50000)]
    v = [x if rng.random() > 0.01 else "new" for x in w]
    rows = [(1, " ".join(w)), (2, " ".join(v)), (3, " ".join(reversed(w)))]
    assert sorted(tuple(r)[::2] for r in jaccard_join.join(frame(spark, rows)).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_large_cells_are_joined_by_rings(spark):
    """A text that all vary, more or less: one cell of many rings and chunks."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(220):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 9])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = jaccard_join.join(frame(spark, rows).repartition(3), block_size=12).drop("class_size")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_join(rows)


@pytest.mark.parametrize("seed", range(6))
def test_cells_connect_as_all_pairs_do(seed):
    rng = np.random.default_rng(seed)
    centers = [rng.choice(4000, 60, replace=False) for _ in range(5)]
    sets = []
    for _ in range(260):
        s = set(centers[rng.integers(5)].tolist())
        for x in rng.choice(sorted(s), rng.integers(0, 12), replace=False).tolist():
            s.remove(x)
        s |= set(rng.integers(0, 4000, rng.integers(0, 10)).tolist())
        sets.append(s)
    shared = [np.array(sorted(s), np.uint64).tobytes() for s in sets]
    sizes = np.array([len(s) for s in sets])
    cell = jaccard_join.Cell(np.arange(len(sets)), sizes, shared, 80)
    cell.join(np.arange(len(sets)), least=16)
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = want[i], want[j]
                want = [a if x == b else x for x in want]
    group = {}
    assert all(group.setdefault(a, b) == b for a, b in zip(cell.group.tolist(), want, strict=True)) and len(set(group.values())) == len(group)
    for i, j in cell.links:
        both = len(sets[i] & sets[j])
        assert 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)


def test_frequent_shingles_are_told_by_their_task():
    texts = [f"common words stand here always {i} " + " ".join(f"u{i}w{j}" for j in range(8)) for i in range(30)]
    sent, told = [], []
    for block in textkit.blocks(pa.array(texts), 10**6):
        for b in jaccard_join.send_block(block, 5, 1, 1):
            for r in b.to_pylist():
                (told if r["kind"] else sent).append(r)
    cls, _, h, _ = jaccard_join._unpack(sent)
    assert (cls == 0).sum() == 1
    assert len(jaccard_join._unpack(told)[0]) == 30
    out = jaccard_join.share(sent, 1)
    assert out.num_rows == 0


def test_components_on_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 200 + i) for i in range(30)]
    df = frame(spark, [*chain, *star, (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(df, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{200 + i: 100 for i in range(30)}}
    assert components.components(df.where("false"), "a", "b").count() == 0


def brute_decontaminate(rows, items):
    win = defaultdict(set)
    for i, t in items:
        w = FOLDED.findall(fold(t))
        if w:
            n = min(13, len(w))
            for s in range(len(w) - n + 1):
                win[tuple(w[s : s + n])].add(None if i is None else str(i))
    sizes, out = {len(g) for g in win}, []
    for d, t in rows:
        w, hit, met = FOLDED.findall(fold(t)), set(), set()
        for s in range(len(w)):
            for n in sizes:
                g = tuple(w[s : s + n])
                if len(g) == n and g in win:
                    hit.update(range(s, s + n))
                    met |= win[g]
        out.append((d, len(w), len(hit), sorted(met, key=lambda i: (i is None, i))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_words", [10**6, 12])
def test_decontamination_against_brute_force(spark, block_words):
    rng = random.Random(6)
    text = lambda k: " ".join(rng.choice(["Ab", "cd", "é1", "x-y", "Z"]) for _ in range(k))
    items = [(i, text(rng.randint(14, 30))) for i in range(6)] + [(20, "Short one"), (21, "q"), (22, None), (23, "..."), (20, "Short one"), (None, "Ab cd")]
    rows = [(i, text(rng.randint(0, 40)) + " " + rng.choice(items[:8])[1] + " " + text(3)) for i in range(40)] + [(50, None), (51, ""), (52, "short ONE"), (52, "short ONE"), (None, items[0][1]), (53, items[1][1][5:])]
    docs, bench = frame(spark, rows), frame(spark, items, "item_id long, text string")
    got = decontaminate.scan(docs, bench, block_words=block_words).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_decontaminate(rows, items)
    bad = {(d, n) for d, n, hit, _ in brute_decontaminate(rows, items) if hit and 20 * hit >= n}
    more = docs.withColumn("n_hit", F.lit(1)).withColumn("row_key", F.lit("k"))
    kept = decontaminate.remove(more, bench, block_words=block_words)
    assert kept.columns == more.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted((r for r in rows if (r[0], len(FOLDED.findall(fold(r[1])))) not in bad), key=repr)
    none = bench.where("false")
    assert all(r.n_hit == 0 for r in decontaminate.scan(docs, none).collect()) and decontaminate.scan(docs.where("false"), bench).count() == 0


def test_decontamination_with_odd_ids_and_long_texts(spark):
    rng = random.Random(16)
    long_text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(100000))
    part = " ".join(long_text.split(" ")[70000:70020])
    bench = frame(spark, [("a-1", part), (None, "lost words here"), (None, "other lost")], "item_id string, text string")
    rows = [(1, long_text), (2, f"x {part} y"), (3, "so lost words here and other lost"), (4, None)]
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.scan(frame(spark, rows), bench).collect()}
    assert got == {1: (100000, 20, ["a-1"]), 2: (22, 20, ["a-1"]), 3: (7, 5, [None]), 4: (0, 0, [])}
    assert {r.doc_id for r in decontaminate.remove(frame(spark, rows), bench).collect()} == {1, 4}


def brute_license(rows):
    base = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
    out = []
    for d, t in rows:
        w, places, labels = FOLDED.findall(fold(t)), [], set()
        for label, phrase in base.items():
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        out.append((d, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    return sorted(out, key=repr)


def test_license_scan_against_brute_force(spark):
    rng = random.Random(7)
    words = ["mit", "MIT", "license", "License.", "apache", "general", "public", "the", "lesser", "é", "x"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "Released under the MIT License."), (103, "mit license"), (104, "mit" + " filler" * 30000 + " mit license"), (102, "Released under the MIT License."), (None, "GNU Lesser General Public License"), (105, "Licensed under CC BY-NC 4.0.")]
    docs = frame(spark, rows).withColumn("matches", F.lit(1)).withColumn("n_words", F.lit(2))
    got = license_scan.digest(license_scan.scan(docs)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == brute_license(rows)
    by = {r.doc_id: r for r in got}
    assert by[102].score == 1.0 and by[102].labels == "mit" and by[105].labels == "cc-by-nc" and by[105].base_labels == "" and by[None].labels == "gpl,lgpl" and by[100].score == 0
    assert all(0 <= r.score <= 1 for r in got)
    assert license_scan.scan(docs.where("false")).count() == 0


def brute_matches(rows):
    """Labels, places and scores by trying every template at every place."""
    texts = [FOLDED.findall(fold(t)) for _, t in rows]
    terms_of = [t[1].split() for t in license_scan.TEMPLATES]
    idf = {w: 1 + np.log((len(rows) + 1) / (sum(w in set(x) for x in texts) + 1)) for terms in terms_of for w in terms}
    out = {}
    for (d, _), words in zip(rows, texts, strict=True):
        found = []
        for (label, _, key, base, least), terms in zip(license_scan.TEMPLATES, terms_of, strict=True):
            phrase = key.split()
            at = next(i for i in range(len(terms)) if terms[i : i + len(phrase)] == phrase)
            rare = sorted(range(len(terms)), key=lambda i: (-idf[terms[i]], i))[: license_scan.RARE]
            for p in range(len(words) - len(phrase) + 1):
                if words[p : p + len(phrase)] == phrase:
                    agree = lambda i: 0 <= p - at + i < len(words) and words[p - at + i] == terms[i]  # noqa: E731, B023
                    near = sum(idf[terms[i]] for i in rare if agree(i)) / sum(idf[terms[i]] for i in rare)
                    score = sum(idf[w] for i, w in enumerate(terms) if agree(i)) / sum(idf[w] for w in terms)
                    if near >= least and score >= least:
                        found.append((label, base, p, round(score, 9)))
        out[d] = sorted(found)
    return out


def test_license_labels_and_scores_against_brute_force(spark):
    rng = random.Random(17)
    rows, whole = [], [t[1].split() for t in license_scan.TEMPLATES]
    for i in range(80):
        w = list(rng.choice(whole))
        for _ in range(rng.choice([0, 2, len(w) // 3, len(w)])):
            w[rng.randrange(len(w))] = rng.choice(["software", "license", "other", "the", "public"])
        lead = [rng.choice(["the", "general", "public", "license", "cc", "by"]) for _ in range(rng.randint(0, 6))]
        rows.append((i, " ".join([*lead, *w[rng.choice([0, 0, 3]) :], *rng.choice(whole)[:12]])))
    rows += [(100 + t, " ".join(w)) for t, w in enumerate(whole)]
    got = {r.doc_id: sorted((m.label, m.base, m.start, round(m.score, 9)) for m in r.matches) for r in license_scan.scan(frame(spark, rows)).collect()}
    want = brute_matches(rows)
    assert got == want and {m[0] for ms in want.values() for m in ms} == {t[0] for t in license_scan.TEMPLATES}


def test_chat_formatting_round_trip_budget_and_masks(spark):
    rng = random.Random(8)
    rows = []
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, 0, "system", "be brief <|end|> \\v \\"))
        for t in range(1, rng.randint(2, 40)):
            rows.append((c, t, rng.choice(["user", "assistant"]), "".join(rng.choice(["word ", "<|", "|>", "\\", "\\b", "\\v", "é ", "<|end|>", "<|assistant|>", "\n"]) for _ in range(rng.randint(0, 60)))))
    rows += [(50, 0, None, None), (50, 0, None, None), (51, None, "a|b<|\\", "x"), (51, 2, "assistant", "y" * 20000), (51, 3, "assistant", "z"), (None, 1, "assistant", "lost")]
    talks = frame(spark, rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).repartition(3)
    windows = chat_format.windows(talks, 128, 32)
    shown = defaultdict(list)
    for r in windows.collect():
        shown[r.conv_id].append(r)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    told = defaultdict(list)
    for r in sorted(rows, key=key):
        told[r[0]].append((r[2] or "", r[3] or ""))
    back = defaultdict(dict)
    for r in chat_format.read_back(windows).collect():
        back[r.conv_id][r.window] = r
    assert set(back) == set(told)
    for c, turns in told.items():
        parts = [back[c][i] for i in sorted(back[c])]
        assert [(t.role, t.text) for p in parts for t in p.turns] == turns
        assert [t for p in parts for t in p.targets] == [t for role, t in turns if role == "assistant"]
    for c, ws in shown.items():
        for w in ws:
            new = len(back[c][w.window].turns)
            # Only a turn that is too long alone, or beside the system turn, may exceed the budget.
            assert w.n_tokens <= 128 or new == 1 and w.n_repeated <= (told[c][0][0] == "system")
            assert w.text.count("<|end|>") == new + w.n_repeated
            if told[c][0][0] == "system":
                assert w.text.startswith("<|system|>")
    d = {r.conv_id: r for r in chat_format.digest(windows).collect()}
    for c, turns in told.items():
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        loss = "".join(text for role, text in turns if role == "assistant")
        assert (d[c].n_turns, d[c].turns_sha256, d[c].loss_chars, d[c].loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.windows(talks.where("false")).count() == 0


def test_history_makes_room_for_the_first_new_turn(spark):
    sizes = [104, 124, 304, 104, 384, 520, 100]
    rows = [(1, t, "user" if t % 2 else "assistant", "w " * (n - chat_format.MARKERS)) for t, n in enumerate(sizes)]
    rows += [(2, t + 1, r, x) for _, t, r, x in rows] + [(2, 0, "system", "s " * 96)]
    got = chat_format.windows(frame(spark, rows, "conv_id long, turn long, role string, text string"), 512, 128).orderBy("conv_id", "window").collect()
    assert [(r.n_repeated, r.n_tokens) for r in got if r.conv_id == 1] == [(0, 228), (1, 428), (0, 488), (0, 520), (0, 100)]
    assert [(r.n_repeated, r.n_tokens) for r in got if r.conv_id == 2] == [(0, 328), (1, 508), (1, 484), (1, 620), (1, 200)]


def test_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn number {t} says something") for t in range(1500)]
    d = chat_format.digest(chat_format.windows(frame(spark, rows, "conv_id long, turn long, role string, text string"))).first()
    assert d.n_turns == 1500


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    # Tables as written and read again between stages.
    step = lambda name, df: (stage[name](spark, df, src).write.parquet(str(tmp_path / name)), spark.read.parquet(str(tmp_path / name)))[1]
    one = step("quality", docs)
    verdict = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    assert {r.doc_id for r in one.collect()} == verdict and one.columns == columns
    two = step("near_duplicates", one)
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert {r.doc_id for r in two.collect()} == {c for _, _, c in brute_join(rows)} and two.columns == columns
    three = step("repeated_passages", two)
    rows = [(r.doc_id, r.text) for r in two.collect()]
    want = {d: (n, gone, sha) for d, n, gone, sha in brute_dedup(rows)}
    got = {r.doc_id: r.text for r in three.collect()}
    assert set(got) == {d for d, (n, gone, _) in want.items() if gone < n or not n} and three.columns == columns
    for d, t in got.items():
        assert hashlib.sha256(" ".join(SPACED.findall(t or "")).encode()).hexdigest() == want[d][2]
    four = step("decontamination", three)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{src}/benchmark.parquet").collect()]
    bad = {d for d, n, hit, _ in brute_decontaminate(list(got.items()), items) if hit and 20 * hit >= n}
    assert {r.doc_id for r in four.collect()} == set(got) - bad and four.columns == columns
    five = stage["packing"](spark, four, src).collect()
    assert {p.doc_id for p in five} == {r.doc_id for r in four.collect()}
    sizes = Counter()
    for p in five:
        sizes[p.sequence_id] += p.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes.values())


def test_scratch_tables_are_written_once_and_cleared(spark):
    from pathlib import Path

    df = scratch.cut(spark.range(5).withColumn("x", F.rand()), "some")
    assert df.collect() == df.collect()
    path = scratch._written[-1].removeprefix("file://")
    assert Path(path).exists()
    scratch.clear(spark)
    assert not Path(path).exists() and not scratch._written


def test_pipeline_stages_on_nulls_and_an_empty_table(spark):
    import corpus_pipeline

    src = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id string"
    rows = [(1, None, None, None, None, "k", "c"), (None, "a b", "en", None, 3, None, None), (None, None, None, "s", None, None, None), (2, "", "", "s", 0, "k", "c"), (2, "", "", "s", 0, "k", "c"), (3, "x " * 20000, "en", "s", 40000, None, "c")]
    docs = frame(spark, rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out, empty = stage(spark, docs, src), stage(spark, docs.where("false"), src)
        assert empty.count() == 0 and empty.columns == out.columns
        if name != "packing":
            assert out.columns == docs.columns
        got = out.collect()
        if name == "quality":
            assert got == []
        elif name == "near_duplicates":
            assert sorted(((r.doc_id or 0, r.text or "") for r in got)) == sorted([(1, ""), (0, "a b"), (0, ""), (2, ""), (3, rows[5][1])])
        elif name in ("repeated_passages", "decontamination"):
            assert len(got) == len(rows)
        else:
            assert {r.doc_id for r in got} == {1, 2, 3, None}
