"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model runs over characters in 63 classes (letters in lower case, capitals, digits, marks; 0 stands before the
text), four at a time. Counting is a map-side sum per task and one shuffle. Everything after is joins of count tables,
sharded by n-gram or by context: continuation counts (how many different characters stand before an n-gram),
count-of-count discounts, context totals and back-off mass, and from them the probability of every n-gram that any
document holds, level by level.

Scoring is a join too: the n-gram counts of the documents, packed per block of texts and shard of n-grams, meet the
same shard of the table of probabilities and are summed per document; the table is never collected or broadcast. Groups
of documents, whose number grows with the characters read, bound what one shard of counts holds. A limit is the QUANTILE of the excess of
trusted texts the model was not trained on, by histograms of exact counts, per language and length class; nothing is
added to it. One rule holds for every count, and every text counts once: a class is mixed with the rest of its language,
that with the other languages and these with a wide spread, each weighing as PRIOR texts, so a class with no trusted
text is judged by its language, and a language with none by all. The wide spread (Student's t with three degrees of
freedom, the fewest with a variance, scaled to that of all held-back texts) stands for what few texts cannot show: below
1 / (1 - QUANTILE) of them the quantile lies beyond all that were seen. With more texts it fades.

Null text counts as empty; empty texts have no perplexity and are rejected. Null languages form a class. Rows with null
or repeated doc_ids are scored one by one. With fewer than two held-back trusted texts no limit is known and nothing is
rejected but empty texts. Texts shorter than all of those spread as the shortest. Clashing columns are replaced.
Texts of any length are scored whole; an empty table of documents gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pricemesh import staging
from pricemesh.llm import blocks, rows

ORDER = 4
BITS = 6
#: One trusted text in FOLD sets limits, the others train.
FOLD = 5
#: The share of held-back trusted texts that a limit lets pass.
QUANTILE = 0.995
#: Ends of the length classes, in characters.
SIZES = (16, 32, 96, 256, 1024)
#: The rest of a language weighs against a length class, other languages against it, and the wide spread against them,
#: as so many texts.
PRIOR = 30
#: Histogram steps of the excess.
STEP = 100
#: The table of probabilities is dealt to so many shards by n-gram, once per group of documents of GROUP characters.
SHARDS, GROUP = 17, 1 << 28
#: A document weighs as so many characters more in its group.
ROW_CHARS = 64
#: At most 2**ROW_BITS documents share a block.
ROW_BITS = 16
#: Log-probabilities are multiples of 1 / UNIT, so their sums do not depend on the order.
UNIT = 1 << 27

#: Letters beyond a-z with a class of their own.
ACCENTED = "äöüßéèêëàâçùûîïôñáíóúœæ"


def _classes() -> np.ndarray:
    table = np.full(0x3001, 63, np.uint8)
    own = {c: 1 + i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz" + ACCENTED + " \n.,")}
    capital, digit, mark, symbol = (1 + len(own) + i for i in range(4))
    for code in range(1, 0x3000):
        c = chr(code)
        if c in own:
            table[code] = own[c]
        elif c.isupper():
            table[code] = capital
        elif c.isdigit():
            table[code] = digit
        elif c in ";:?'\"-()":
            table[code] = mark
        elif code < 128:
            table[code] = symbol
    table[0] = 63
    return table


_CLASS = _classes()


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The packed 4-gram that ends at every character of the texts, and the length of each text."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    classes = _CLASS[np.minimum(codes, len(_CLASS) - 1)].astype(np.int32)
    place = np.arange(len(classes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    packed = classes.copy()
    for back in range(1, ORDER):
        before = np.zeros_like(classes)
        before[back:] = classes[:-back] if len(classes) > back else 0
        before[place < back] = 0
        packed |= before << BITS * back
    return packed, lengths


def count(texts: DataFrame) -> DataFrame:
    """(gram, n) over a column of texts: summed per task, then over tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, times = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in blocks.cut(batches, "text"):
            new, n = np.unique(grams(blocks.texts(batch.column(0)))[0], return_counts=True)
            both, at = np.unique(np.concatenate([found, new]), return_inverse=True)
            times = np.bincount(at, np.concatenate([times, n]), len(both)).astype(np.int64)
            found = both
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(times)], ["gram", "n"])

    return texts.select("text").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _tail(gram: str, order: int) -> Column:
    return F.col(gram).bitwiseAND(F.lit((1 << BITS * order) - 1))


def levels(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 to 4: (gram, own) and (context, back): the discounted share of a seen n-gram in its context, and
    the mass that its context passes on to the next lower order."""
    tables = [counts]
    for order in range(ORDER - 1, 0, -1):
        tables.append(staging.written(tables[-1].groupBy(_tail("gram", order).alias("gram")).agg(F.count("*").alias("n")), "kn-counts"))
    out = []
    for table in reversed(tables):
        seen = {r.n: r["count"] for r in table.where("n <= 4").groupBy("n").count().collect()}
        n1, n2, n3, n4 = (seen.get(k, 0) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        # Count tables too small for the estimate fall back on half a count, within what a count can lose.
        cut = [k - (k + 1) * y * b / a if a and b else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        cut = [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), cut)]
        d = F.when(F.col("n") == 1, cut[0]).when(F.col("n") == 2, cut[1]).otherwise(cut[2])
        marked = table.select("gram", "n", F.shiftright("gram", BITS).alias("context"), d.alias("d"))
        totals = marked.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("taken"))
        own = marked.join(totals, "context").select("gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("own"))
        out.append((own, totals.select("context", (F.col("taken") / F.col("total")).alias("back"))))
    return out


def probabilities(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, log_p) of every wanted gram: p = own + back * p of the gram without its first character."""
    p = wanted.select("gram").withColumn("p", F.lit(1.0 / (1 << BITS)))
    for order, (own, back) in enumerate(levels(counts), 1):
        keyed = p.withColumns({"_gram": _tail("gram", order), "_context": F.shiftright(_tail("gram", order), BITS)})
        keyed = keyed.join(own.withColumnRenamed("gram", "_gram"), "_gram", "left")
        keyed = keyed.join(back.withColumnRenamed("context", "_context"), "_context", "left")
        # A context never seen says nothing: all its mass is passed on.
        p = keyed.select("gram", (F.coalesce("own", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("p")).alias("p"))
    return p.select("gram", F.log("p").alias("log_p"))


#: What a block tells of its rows.
_TOLD = [pa.field(*f) for f in (("doc_id", pa.int64()), ("row_hash", pa.int64()), ("lang", pa.string()), ("length", pa.int64()))]
_DOCS = "array<struct<doc_id: bigint, row_hash: bigint, lang: string, length: bigint>>"


def _packed(gram: np.ndarray, row: np.ndarray, n: np.ndarray) -> bytes:
    """Document n-gram counts sorted by gram and row, as steps from one to the next, compressed."""
    steps = [np.diff(gram, prepend=0).astype(np.uint32), np.diff(row, prepend=0).astype(np.uint16), n.astype(np.min_scalar_type(n.max(initial=0)))]
    batch = pa.record_batch(steps, ["gram", "row", "n"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = pa.ipc.open_stream(packed).read_all().combine_chunks()
    gram, row, n = (steps.column(k).to_numpy() for k in range(3))
    return np.cumsum(gram, dtype=np.int64), np.cumsum(row, dtype=np.uint16), n


def document_counts(docs: DataFrame, text: str = "text", groups: int = 1) -> DataFrame:
    """The n-gram counts of every document: (cell, block, counts, docs), a row per block of texts and shard of grams.

    A cell is one shard of one group of blocks; docs tells the rows of a block and stands with one of its shards only.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.cut(batches, "_text", most_rows=1 << ROW_BITS):
            packed, lengths = grams(blocks.texts(batch.column(0)))
            key = packed.astype(np.int64) << ROW_BITS | np.repeat(np.arange(len(lengths)), lengths)
            key.sort()
            first = np.flatnonzero(np.diff(key, prepend=-1))
            key, n = key[first], np.diff(first, append=len(key))
            gram, row = key >> ROW_BITS, key & (1 << ROW_BITS) - 1
            block = batch.column(1)[0].as_py()
            home = zlib.crc32(b"%d" % block)
            group, teller = home % groups, home // groups % SHARDS
            parts = [np.flatnonzero(gram % SHARDS == k) for k in range(SHARDS)]
            parts = {k: at for k, at in enumerate(parts) if len(at) or k == teller}
            told = pa.StructArray.from_arrays([*batch.columns[2:], pa.array(lengths)], fields=_TOLD)
            ends = np.cumsum([0] + [len(told) * (k == teller) for k in parts])
            told = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), told, mask=pa.array([k != teller for k in parts]))
            counts = [_packed(gram[at], row[at], n[at]) for at in parts.values()]
            cells = [group * SHARDS + k for k in parts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells, pa.int64()), pa.array([block] * len(parts), pa.int64()), pa.array(counts, pa.binary()), told],
                ["cell", "block", "counts", "docs"],
            )

    columns = [F.col(f"`{text}`").alias("_text"), F.monotonically_increasing_id().alias("_row")]
    columns += [F.col("doc_id").cast("bigint").alias("doc_id"), rows.row_hash(docs).alias("row_hash")]
    source = docs.select(*columns, F.coalesce("lang", F.lit("")).alias("lang"))
    return source.mapInArrow(run, f"cell bigint, block bigint, counts binary, docs {_DOCS}")


def score(docs: DataFrame, table: DataFrame, text: str = "text", groups: int = 1) -> DataFrame:
    """doc_id, row_hash, lang, length, nll (mean negative log-probability per character, null for empty texts).

    The n-gram counts of the documents meet the table of probabilities cell by cell and are summed per document, first
    within a shard of grams, then over the shards.
    """
    log_p = (F.round(F.col("log_p").cast("float") * UNIT) / UNIT).alias("log_p")
    group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    dealt = table.select("gram", log_p, group.alias("cell")).withColumn("cell", F.col("cell") * SHARDS + F.col("gram") % SHARDS)

    def summed(counts: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("gram")
        grams_known, values = known["gram"].to_numpy(), known["log_p"].to_numpy()
        sums = []
        for packed in counts["counts"]:
            gram, row, n = _unpacked(packed.as_py())
            found = np.searchsorted(grams_known, gram)
            found[found == len(grams_known)] = 0
            p = np.where(grams_known[found] == gram, values[found], 0.0) if len(grams_known) else np.zeros(len(gram))
            sums.append(np.bincount(row, n * p).astype("<f8").tobytes())
        return pa.table([counts["block"], pa.array(sums, pa.binary()), counts["docs"]], ["block", "sums", "docs"])

    def added(parts: pa.Table) -> pa.Table:
        told = parts["docs"].drop_null().combine_chunks().flatten().flatten()
        total = np.zeros(len(told[0]))
        for part in parts["sums"].to_pylist():
            some = np.frombuffer(part, "<f8")
            total[: len(some)] += some
        length = told[3].to_numpy()
        nll = pa.array(-total / np.maximum(length, 1), mask=length == 0)
        return pa.table([*told, nll], ["doc_id", "row_hash", "lang", "length", "nll"])

    found = document_counts(docs, text, groups).groupBy("cell").cogroup(dealt.groupBy("cell"))
    parts = found.applyInArrow(summed, f"block bigint, sums binary, docs {_DOCS}")
    return parts.groupBy("block").applyInArrow(added, "doc_id bigint, row_hash bigint, lang string, length bigint, nll double")


def _size() -> Column:
    """Length classes: the shorter a text, the wider its perplexity spreads."""
    size = F.lit(len(SIZES))
    for k, end in reversed(list(enumerate(SIZES))):
        size = F.when(F.col("length") < end, k).otherwise(size)
    return size


def limits(trusted: DataFrame, quantile: float = QUANTILE) -> tuple[DataFrame, tuple[float, float, int] | None]:
    """(lang, size, center, most) of every language with trusted texts, and (center, most, shortest) for any other one.

    center: mean negative log-probability, most: highest excess over it that passes (see _excess), shortest: length of
    the shortest trusted text; center and most are drawn toward all languages as PRIOR texts of them would. None where
    fewer than two trusted texts are at hand.
    """
    texts = trusted.where("nll is not null").select("lang", "length", "nll")
    langs = texts.groupBy("lang").agg(F.count("*").alias("n"), F.sum("nll").alias("total"))
    n, total, shortest = texts.agg(F.count("*"), F.sum("nll"), F.min("length")).first()
    if n < 2:
        return langs.select("lang", F.lit(0).alias("size"), *[F.lit(0.0).alias(c) for c in ("center", "most")]).where("false"), None
    mean = total / n
    langs = staging.written(langs.select("lang", F.round((F.col("total") + PRIOR * mean) / (F.col("n") + PRIOR), 6).alias("center")), "centers")
    binned = texts.join(langs, "lang").select("lang", "center", _size().alias("size"), F.floor(_excess(shortest) * STEP).alias("bin"))
    counted = staging.written(binned.groupBy("lang", "center", "size", "bin").agg(F.count("*").alias("n")), "excess-bins")
    whole = counted.groupBy("bin").agg(F.sum("n").alias("n")).toPandas().set_index("bin")["n"]  # one row per bin of a histogram
    wide = _wide(whole, quantile)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf.groupby("bin")["n"].sum()
        others = _mixed(whole.sub(mine, fill_value=0), wide)
        found = []
        for size in range(len(SIZES) + 1):
            here = pdf[pdf["size"] == size].set_index("bin")["n"]
            found.append((_quantile(_mixed(here, _mixed(mine.sub(here, fill_value=0), others)), quantile) + 1) / STEP)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "size": range(len(found)), "center": pdf["center"].iloc[0], "most": found})

    found = staging.written(counted.groupBy("lang").applyInPandas(run, "lang string, size int, center double, most double"), "limits")
    return found, (mean, (_quantile(_mixed(whole, wide), quantile) + 1) / STEP, shortest)


def _wide(counts: pd.Series, quantile: float) -> pd.Series:
    """Share of Student's t with three degrees of freedom, as wide as a histogram, up to every bin of it and on to the
    quantile."""
    scale = STEP * np.sqrt((counts * ((counts.index + 0.5) / STEP) ** 2).sum() / (counts.sum() - 1))

    def upto(bins: np.ndarray) -> np.ndarray:
        t = (bins + 1) / scale / np.sqrt(3)
        return 0.5 + (t / (1 + t * t) + np.arctan(t)) / np.pi

    top = scale
    while upto(top) < quantile - 1e-9:
        top *= 2
    bins = np.union1d(counts.index, np.arange(int(top) + 1))
    return pd.Series(upto(bins), bins)


def _mixed(counts: pd.Series, prior: pd.Series) -> pd.Series:
    """Share up to every bin of prior, which weighs against the counts as PRIOR texts."""
    return (counts.reindex(prior.index, fill_value=0).cumsum() + PRIOR * prior) / (counts.sum() + PRIOR)


def _quantile(upto: pd.Series, quantile: float) -> int:
    """First bin up to which `quantile` of a distribution lies."""
    return int(upto.index[min(np.searchsorted(upto.to_numpy(), quantile - 1e-9), len(upto) - 1)])


def _spread(shortest: int) -> Column:
    """Sums of as many characters as a text has spread by the root of its length."""
    return F.sqrt(F.greatest(F.col("length"), F.lit(shortest)))


def _excess(shortest: int) -> Column:
    """What a text costs beyond the center of its language, over its spread."""
    return (F.col("nll") - F.col("center")) * F.col("length") / _spread(shortest)


def judge(docs: DataFrame, trusted: DataFrame, text: str = "text", quantile: float = QUANTILE) -> DataFrame:
    """doc_id, row_hash, lang, perplexity, most (its limit) and kept of every row of docs.

    trusted holds the doc_id of trusted rows.
    """
    ids = trusted.select("doc_id").where("doc_id is not null").distinct()
    held_back = F.pmod(F.xxhash64("doc_id"), F.lit(FOLD)) == 0
    texts = docs.select("doc_id", F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    counts = staging.written(count(texts.hint("merge").join(ids.where(~held_back), "doc_id", "left_semi")), "kn-counts")
    wanted = staging.written(count(texts), "kn-wanted")
    groups = 1 + ((wanted.agg(F.sum("n")).first()[0] or 0) + ROW_CHARS * texts.count()) // GROUP
    scored = staging.written(score(docs, probabilities(wanted, counts), text, groups), "perplexities")
    known, other = limits(scored.join(ids.where(held_back), "doc_id", "left_semi"), quantile)
    center, excess, shortest = other or (None, None, 0)
    found = scored.withColumn("size", _size()).join(known.withColumnRenamed("most", "_most"), ["lang", "size"], "left")
    center, excess = (F.coalesce(c, F.lit(x).cast("double")) for c, x in (("center", center), ("_most", excess)))
    most = F.when(F.col("length") > 0, center + excess * _spread(shortest) / F.col("length"))
    passes = F.col("nll").isNotNull() & F.coalesce(F.col("nll") <= most, F.lit(True))
    return found.select(
        "doc_id", "row_hash", "lang", F.exp("nll").alias("perplexity"), F.exp(most).alias("most"), passes.alias("kept")
    )


def keep_good(docs: DataFrame, trusted: DataFrame, text: str = "text") -> DataFrame:
    """docs without the rows that are rejected."""
    bad = judge(docs, trusted, text).where(~F.col("kept")).select("doc_id", "row_hash").distinct()
    return rows.without(docs, staging.written(bad, "rejected"))
