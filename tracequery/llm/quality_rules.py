"""Quality rules: fixed text rules and an n-gram perplexity band for each language.

The language model is a modified Kneser-Ney model of order four over code
points, lower-cased one by one; those beyond 16 bits share 6400 private ones.
Spark counts the documents that hold each 4-gram, over all documents, so what
one document repeats counts once.  Lower orders use continuation counts.  The
model grows with the corpus: its counts, its probabilities and its lookup are
tables and exchanges by n-gram, and nothing of it reaches the driver but counts
of counts.  Every context has at most 2**16 followers, and every n-gram at most
2**16 longer ones, which bounds the groups that meet.

Documents are read once, in units of ``UNIT_BYTES`` of text (more for one longer
text), which are written with their distinct 4-grams.  The model's costs (the
negative log probabilities) are cut into blocks of sorted arrays of n-grams;
each unit's n-grams are looked up there, and the unit's texts meet their costs.

A document's log perplexity is its mean cost per code point, and its deviation
is the difference from its language's median, in units of what means of texts
of its length vary by: sqrt(1 / n + 1 / SPREAD) for n code points, as texts
differ by more than chance however long they are.  For each language exact
counts of histograms over all documents that pass the fixed rules give the
median and the deviations' quartiles; the band reaches from their median
``width`` times as far as the quartiles, or as ``LEAST`` where these are closer,
to each side, and 1 + FEW / sqrt(documents) times as far as that, as quartiles
of few documents are uncertain.  These parameters were chosen on the labelled
documents of sf0.001, sf0.01 and sf0.1 that pass the fixed rules: 99 % of those
labelled good are kept on each.  Documents outside their language's band are
rejected.

Defined results: a null text has no words and fails the fixed rules; a null
language is a language of its own; repeated rows count as often as they
occur and get equal verdicts; a text of any length is one document, counted
and scored whole; a language's only document is within its band; an empty
table gives no rows; extra columns are kept by ``filter_docs`` and not read by
``judge``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from . import textkit as tk

ORDER, BITS = 4, 16
SYMBOLS = 1 << BITS
SPACE = 0x20
UNIT_BYTES = 16_000_000
#: N-grams of a model block, and bytes of lookups that meet it in one task.
BLOCK_GRAMS, LOOKUP_BYTES = 500_000, 32_000_000
#: Steps of the histograms of log perplexities, and of deviations' inverse hyperbolic sines.
STEP, FINE = 0.001, 0.01
WIDTH, LEAST, SPREAD, FEW = 4.0, 0.5, 4000, 3.0

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[0x0A] = False


def _lowered(code: int) -> int:
    low = chr(code).lower()
    return ord(low) if len(low) == 1 and ord(low) < SYMBOLS else code


#: The symbol of each code point of 16 bits.
_LOWER = np.array([_lowered(c) for c in range(SYMBOLS)], np.uint16)


def gram_keys(block: tk.Block) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram ending at each code point, spaces standing before a text, and the count of code points before each text."""
    code = np.frombuffer(block.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    near = _LOWER[np.minimum(code, SYMBOLS - 1)]
    symbol = np.where(code < SYMBOLS, near, 0xE000 + code % 6400).astype(tk.U64)
    first = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])[block.offsets]
    key = symbol.copy()
    for j in range(1, ORDER):
        before = np.full_like(symbol, SPACE)
        before[j:] = symbol[: len(symbol) - j]
        for k in range(j):
            edge = first[:-1] + k
            edge = edge[edge < first[1:]]
            before[edge] = SPACE
        key |= before << tk.U64(BITS * j)
    return key, first


def document_counts(key: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of a block and how many of its texts hold each."""
    order = np.argsort(key, kind="stable")
    ordered, text = key[order], np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    once = new.copy()
    once[1:] |= text[1:] != text[:-1]
    heads = np.flatnonzero(new)
    return ordered[heads], np.add.reduceat(once.astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key occurred at an earlier place, and all places of keys that occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later = order[1:][same]
    return later, np.union1d(later, order[:-1][same])


def fixed_rules(block: tk.Block) -> dict[str, np.ndarray]:
    words = tk.Words(block)
    n = block.n
    lead = (block.data & 0xC0) != 0x80
    spaced = tk.SPACED[block.data]
    starts, ends, first = tk.spans(block, _NOT_NEWLINE)
    doc = np.repeat(np.arange(n), np.diff(first))
    filled = np.concatenate([[0], np.cumsum(spaced)])
    worded = filled[ends] > filled[starts]
    starts, ends, doc = starts[worded], ends[worded], doc[worded]
    of_doc = tk.mix(np.arange(1, n + 1, dtype=tk.U64) * tk.U64(0x9E3779B97F4A7C15))
    later, _ = _again(tk.span_hashes(block.data, starts, ends) ^ of_doc[doc])
    at = words.whole(3)
    _, twice = _again(words.grams(3, 7001)[at] ^ of_doc[words.doc[at]])
    repeated = tk.covered(len(words.hash), at[twice], 3)
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": _sums(lead & spaced, block.offsets),
        "n_symbols": _sums(_IS_SYMBOL[block.data], block.offsets),
        "n_dup_lines": np.bincount(doc[later], minlength=n).astype(np.int64),
        "n_repeat_words": _sums(repeated, words.first),
    }


def _write_rows(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _read_rows(packed) -> pa.RecordBatch:
    return pa.ipc.open_stream(packed).read_next_batch()


_UNITS = "unit long, block long, texts binary, grams binary, counts binary"


def write_units(docs: DataFrame) -> DataFrame:
    """Units of text, written once: blocks with some of a unit's rows and their figures, and one row with its distinct n-grams and document counts.

    A block's rows have the columns of ``docs``, then doc_id, lang and the
    figures of the fixed rules, by place: names may clash.
    """
    at_text = docs.columns.index("text")

    def cut(batches):
        from pyspark import TaskContext

        unit, size, held = TaskContext.get().partitionId() << 32, 0, []

        def row(block=None, texts=None, grams=None, counts=None):
            return pa.RecordBatch.from_arrays([pa.array([unit], pa.int64()), pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in (texts, grams, counts))], ["unit", "block", "texts", "grams", "counts"])

        def close():
            grams, of = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
            counts = np.bincount(of, np.concatenate([c for _, c in held]), len(grams)).astype(np.uint32)
            return row(grams=tk.planes(grams), counts=tk.planes(counts))

        for batch in batches:
            for block in tk.blocks(batch.column(at_text)):
                if held and size + len(block.data) > UNIT_BYTES:
                    yield close()
                    unit, size, held = unit + 1, 0, []
                size += len(block.data)
                key, first = gram_keys(block)
                held.append(document_counts(key, first))
                figures = fixed_rules(block)
                picked = batch.slice(block.lo, block.n)
                rows = pa.RecordBatch.from_arrays([*picked.columns, *(pa.array(v, pa.int64()) for v in figures.values())], [*picked.schema.names, *figures])
                yield row(len(held) - 1, _write_rows(rows))
        if held:
            yield close()

    rows = docs.select(*docs.columns, F.col("doc_id").cast("long").alias("__tq_doc"), F.col("lang").cast("string").alias("__tq_lang"))
    return scratch.cut(rows.mapInArrow(cut, _UNITS), "quality-units")


def count_grams(units: DataFrame) -> DataFrame:
    """(gram, n): how many of all documents hold each n-gram."""

    def told(batches):
        for batch in batches:
            for grams, counts in zip(batch.column("grams").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(tk.unplanes(grams, np.int64)), pa.array(tk.unplanes(counts, np.uint32).astype(np.int64))], ["gram", "n"])

    rows = units.where("grams is not null").select("grams", "counts").mapInArrow(told, "gram long, n long")
    return scratch.cut(rows.groupBy("gram").agg(F.sum("n").alias("n")), "quality-grams")


def discounts(counts_of_counts: dict[int, int]) -> list[float]:
    """Discounts for counts 1, 2 and more; plain values where the counts of counts have gaps."""
    n1, n2, n3, n4 = (counts_of_counts.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), most) for d, most in zip(found, (0.95, 1.9, 2.9), strict=True)]


def probabilities(counted: DataFrame) -> DataFrame:
    """(gram, p): interpolated modified Kneser-Ney probabilities of all seen 4-grams' last symbols after the others."""
    levels = [counted]
    for n in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND((1 << BITS * n) - 1)
        levels.insert(0, scratch.cut(levels[0].groupBy(shorter.alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"quality-grams{n}"))
    found = None
    for n, level in enumerate(levels, 1):
        d1, d2, d3 = discounts({r["n"]: r["count"] for r in level.where("n < 5").groupBy("n").count().collect()})
        cut = F.least(F.col("n").cast("double"), F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3))
        of = Window.partitionBy(F.shiftrightunsigned("gram", BITS))
        if n == 1:
            # One context, of at most 2**16 followers.
            sums = level.agg(F.sum("n").alias("total"), F.sum(cut).alias("freed"))
            rows = level.join(F.broadcast(sums))
            found = rows.select("gram", ((F.col("n") - cut) / F.col("total") + F.col("freed") / F.col("total") / SYMBOLS).alias("p"))
        else:
            rows = level.withColumns({"total": F.sum("n").over(of), "freed": F.sum(cut).over(of), "shorter": F.col("gram").bitwiseAND((1 << BITS * (n - 1)) - 1)})
            lower = found.select(F.col("gram").alias("shorter"), F.col("p").alias("lower"))
            found = rows.join(lower, "shorter").select("gram", ((F.col("n") - cut) / F.col("total") + F.col("freed") / F.col("total") * F.col("lower")).alias("p"))
    return found


def _block_of(grams: np.ndarray, n: int) -> np.ndarray:
    return (tk.mix(grams.view(tk.U64)) % tk.U64(n)).astype(np.int64)


def _by_block(grams: np.ndarray, n: int):
    """(block, places of its n-grams, ascending) of sorted n-grams."""
    block = _block_of(grams, n)
    order = np.argsort(block, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(block[order], prepend=-1)), len(order))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(block[order[lo]]), order[lo:hi]


def look_up(units: DataFrame, found: DataFrame, n_grams: int) -> DataFrame:
    """(unit, grams, costs): the costs of each unit's n-grams, in as many sorted arrays as there are model blocks."""
    spark = units.sparkSession
    n = scratch.parts(spark, n_grams, BLOCK_GRAMS)
    asked = units.where("grams is not null").select("unit", "grams")
    size = asked.agg(F.sum(F.octet_length("grams"))).first()[0] or 0
    # Lookups of one block are dealt to so many tasks, each with its own copy of the block.
    copies = max(1, -(-size // (n * LOOKUP_BYTES)))

    def ask(batches):
        for batch in batches:
            for unit, grams in zip(batch.column("unit").to_pylist(), batch.column("grams").to_pylist(), strict=True):
                grams = tk.unplanes(grams, np.uint64)
                rows = [(b, unit, tk.planes(grams[at])) for b, at in _by_block(grams, n)]
                b, u, g = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array([unit % copies] * len(b), pa.int64()), pa.array(u, pa.int64()), pa.array(g, pa.binary())], ["block", "copy", "unit", "grams"])

    def answer(model: pa.Table, wanted: pa.Table) -> pa.Table:
        grams = np.asarray(model.column("gram")).view(tk.U64)
        order = np.argsort(grams)
        grams, cost = grams[order], np.asarray(model.column("cost"))[order]
        costs = [tk.planes(cost[np.searchsorted(grams, tk.unplanes(g, np.uint64))]) for g in wanted.column("grams").to_pylist()]
        return pa.table({"unit": wanted.column("unit"), "grams": wanted.column("grams"), "costs": pa.array(costs, pa.binary())})

    def dealt(batches):
        for batch in batches:
            block = _block_of(np.asarray(batch.column("gram")), n)
            yield pa.RecordBatch.from_arrays([pa.array(block), batch.column("gram"), batch.column("cost")], ["block", "gram", "cost"])

    priced = found.select("gram", (-F.log(F.greatest("p", F.lit(1e-30)))).cast("float").alias("cost"))
    model = priced.mapInArrow(dealt, "block long, gram long, cost float").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)).cast("array<long>")))
    wanted = asked.mapInArrow(ask, "block long, copy long, unit long, grams binary")
    key = ["block", "copy"]
    tasks = n * copies
    return model.repartition(tasks, *key).groupBy(*key).cogroup(wanted.repartition(tasks, *key).groupBy(*key)).applyInArrow(answer, "unit long, grams binary, costs binary")


_RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SCORED = "doc_id long, lang string, unit long, block long, place long, " + ", ".join(f"{r} long" for r in _RULES) + ", n_chars long, log_perplexity double"


def measure(units: DataFrame, at_text: int) -> DataFrame:
    """One row for each document, written: doc_id, lang, its unit, block and place, the fixed rules' figures, n_chars, log_perplexity (null without text)."""
    spark = units.sparkSession
    counted = count_grams(units)
    priced = look_up(units, probabilities(counted), counted.count())
    size = units.agg(F.sum(F.octet_length("texts"))).first()[0] or 0
    names = [c.split()[0] for c in _SCORED.split(", ")]

    def scored(texts: pa.Table, costs: pa.Table) -> pa.Table:
        grams = np.concatenate([np.zeros(0, tk.U64), *(tk.unplanes(g, np.uint64) for g in costs.column("grams").to_pylist())])
        cost = np.concatenate([np.zeros(0, np.float32), *(tk.unplanes(c, np.float32) for c in costs.column("costs").to_pylist())]).astype(float)
        order = np.argsort(grams)
        grams, cost = grams[order], cost[order]
        out = []
        for unit, number, packed in zip(*(texts.column(c) for c in ("unit", "block", "texts")), strict=True):
            rows = _read_rows(packed.as_buffer())
            own = rows.columns[-len(_RULES) - 2 :]
            for block in tk.blocks(rows.column(at_text), 1 << 62):
                key, first = gram_keys(block)
                n = np.diff(first)
                total = _sums(cost[np.searchsorted(grams, key)], first) if len(key) else np.zeros(block.n)
                mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
                where = [pa.array([unit.as_py()] * len(n), pa.int64()), pa.array([number.as_py()] * len(n), pa.int64()), pa.array(np.arange(len(n)))]
                out.append(pa.RecordBatch.from_arrays([*own[:2], *where, *own[2:], pa.array(n, pa.int64()), mean], names))
        return pa.Table.from_batches(out)

    n = scratch.parts(spark, size, 32_000_000)
    texts = units.where("texts is not null").select("unit", "block", "texts").repartition(n, "unit").groupBy("unit")
    return scratch.cut(texts.cogroup(priced.repartition(n, "unit").groupBy("unit")).applyInArrow(scored, _SCORED), "quality-measured")


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def _points(steps: DataFrame, points: dict[str, float], value) -> DataFrame:
    """Values of a histogram (lang, step, n) below which the given shares of each language lie."""
    by = Window.partitionBy("lang")
    run = steps.withColumns({"upto": F.sum("n").over(by.orderBy("step")), "all": F.sum("n").over(by)})
    return run.groupBy("lang").agg(F.max("all").alias("all"), *(value(F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("step")))).alias(name) for name, q in points.items()))


def bands(measured: DataFrame, width: float, least: float) -> DataFrame:
    """(band_lang, middle, low, high): each language's median log perplexity and its bounds of deviations."""
    passed = measured.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")) & F.col("log_perplexity").isNotNull())
    count = lambda df, step: df.groupBy("lang", F.floor(step).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    middle = scratch.cut(_points(count(passed, F.col("log_perplexity") / STEP), {"middle": 0.5}, lambda s: (s + 0.5) * STEP).select(F.col("lang").alias("band_lang"), "middle").coalesce(1), "quality-middle")
    each = _deviation(passed, middle)
    step = F.log(F.col("deviation") + F.sqrt(F.col("deviation") ** 2 + 1)) / FINE
    p = _points(count(each, step), {"p25": 0.25, "p50": 0.5, "p75": 0.75}, lambda s: F.sinh((s + 0.5) * FINE))
    reach = width * (1 + FEW / F.sqrt("all"))
    return middle.join(p, F.col("band_lang").eqNullSafe(F.col("lang"))).select(
        "band_lang",
        "middle",
        (F.col("p50") - reach * F.greatest(F.lit(least), F.col("p50") - F.col("p25"))).alias("low"),
        (F.col("p50") + reach * F.greatest(F.lit(least), F.col("p75") - F.col("p50"))).alias("high"),
    )


def _deviation(measured: DataFrame, middle: DataFrame) -> DataFrame:
    joined = measured.join(middle, F.col("lang").eqNullSafe(F.col("band_lang")), "left")
    return joined.withColumn("deviation", (F.col("log_perplexity") - F.col("middle")) * F.sqrt(F.col("n_chars") * SPREAD / (F.col("n_chars") + SPREAD)))


def _verdicts(measured: DataFrame, width: float, least: float) -> DataFrame:
    found = scratch.cut(bands(measured, width, least).coalesce(1), "quality-bands")
    out = _deviation(measured, found).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("deviation").between(F.col("low"), F.col("high")), F.lit(True)))


def verdicts(docs: DataFrame, width: float = WIDTH, least: float = LEAST) -> DataFrame:
    """The rows of ``measure`` with deviation, base_failed and kept."""
    docs = docs.select("doc_id", "lang", "text")
    return _verdicts(measure(write_units(docs), 2), width, least)


def judge(docs: DataFrame, width: float = WIDTH, least: float = LEAST) -> DataFrame:
    """One row for each document: doc_id, lang, the figures, log_perplexity, deviation, base_failed, kept."""
    return verdicts(docs, width, least).select("doc_id", "lang", *_RULES, "log_perplexity", "deviation", "base_failed", "kept")


def filter_docs(docs: DataFrame, width: float = WIDTH, least: float = LEAST) -> DataFrame:
    """The documents that pass, unchanged, from the written units; a byte for each document says which of a block stay."""
    units = write_units(docs)
    found = _verdicts(measure(units, docs.columns.index("text")), width, least)
    flag = F.struct("place", F.when(F.col("kept"), "1").otherwise("0").alias("flag"))
    flags = found.groupBy("unit", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(flag)), lambda x: x["flag"]), "").alias("flags"))
    # Written, so that its size is known when the join with the texts is planned.
    flags = scratch.cut(flags.where(F.contains("flags", F.lit("1"))), "quality-flags")
    n = len(docs.columns)

    def kept(batches):
        for batch in batches:
            for packed, flags in zip(batch.column("texts"), batch.column("flags").to_pylist(), strict=True):
                rows = _read_rows(packed.as_buffer())
                own = pa.RecordBatch.from_arrays(rows.columns[:n], rows.schema.names[:n])
                yield own.filter(pa.array(np.frombuffer(flags.encode(), np.uint8) == ord("1")))

    return units.where("texts is not null").select("unit", "block", "texts").join(flags, ["unit", "block"]).select("texts", "flags").mapInArrow(kept, docs.schema)
